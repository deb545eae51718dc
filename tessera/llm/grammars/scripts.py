"""JSON, Python, JavaScript and TypeScript."""

from __future__ import annotations

import re

from tessera.llm.lexing import C_COMMENT, NAME, SPACE, Lexer, LexError, Tokens, close_of, template_end
from tessera.llm.peg import Grammar

# ---- JSON

JSON_WORDS = {"true", "false", "null"}
JSON_LEXER = Lexer(
    [
        ("SKIP", r"[ \t\r\n]+"),
        ("STR", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'),
        ("NUM", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"),
        ("NAME", r"true|false|null"),
        ("OP", r"[\[\]{},:]"),
    ],
    JSON_WORDS,
)
JSON = Grammar(
    """
file = value EOF
value = STR / NUM / "{" (pair % ",")? "}" / "[" (value % ",")? "]" / "true" / "false" / "null"
pair = STR ":" value
""",
    JSON_WORDS,
)

# ---- Python

PYTHON_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_TOKEN = re.compile(
    r"""(?P<SKIP>[ \t\f]+|\\\r?\n|\#[^\n]*)|(?P<LINE>\r?\n|\r)
    |(?P<PRE>[rR]?[fFtT][rR]?|[rRbBuU]?[rRbB]?)(?P<Q>\"\"\"|'''|"|')
    |(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<NAME>[^\W\d]\w*)
    |(?P<OP>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:;.=])""",
    re.X,
)
_PY_ENDS = {q: re.compile(rf"(?:[^\\{q[0]}{'' if len(q) == 3 else chr(10)}]|\\.{'' if len(q) == 1 else f'|{q[0]}(?!{q[0]}{q[0]})|{q[0]}{q[0]}(?!{q[0]})'})*?{q}", re.S) for q in ('"', "'", '"""', "'''")}


def _format_end(text: str, at: int, quote: str) -> int:
    """The end of an interpolated string; its expressions may hold strings and brackets."""
    start, n = at, len(quote)
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + n
        elif c == "\n" and n == 1:
            break
        elif c == "{" and text[at + 1 : at + 2] != "{":
            at = close_of(text, at + 1, comments=False)
        elif c in "{}":
            at += 2 if text[at + 1 : at + 2] == c else 1
        else:
            at += 1
    raise LexError(start, "unterminated literal or comment")


def python_lexer(text: str) -> Tokens:
    tokens, at, n = Tokens(), 0, len(text)
    indents, brackets, fresh = [0], [], True
    while at < n:
        if fresh and not brackets:
            m = re.compile(r"[ \t\f]*").match(text, at)
            body = m.end()
            if body >= n:
                break
            if text[body] in "#\r\n" or text.startswith("\\\n", body):
                if text[body] in "#\r\n":
                    end = text.find("\n", body)
                    at = n if end < 0 else end + 1
                    continue
            width = len(m.group().rpartition("\f")[2].expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                tokens.add("INDENT", "", True, body)
            while width < indents[-1]:
                indents.pop()
                tokens.add("DEDENT", "", True, body)
            if width != indents[-1]:
                raise LexError(body, "inconsistent indentation")
            at, fresh = body, False
        m = _PY_TOKEN.match(text, at)
        if m is None:
            raise LexError(at, "unexpected character")
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "SKIP":
            at = end
            continue
        if kind == "LINE":
            if not brackets and not fresh:
                tokens.add("NEWLINE", "", False, at)
                fresh = True
            at = end
            continue
        if kind == "Q":
            quote = m.group("Q")
            if set("fFtT") & set(m.group("PRE")):
                end = _format_end(text, end, quote)
            else:
                m2 = _PY_ENDS[quote].match(text, end)
                if not m2:
                    raise LexError(at, "unterminated literal or comment")
                end = m2.end()
            tokens.add("STR", "", False, at)
            at = end
            continue
        if kind == "NUM" and re.match(r"\w", text[end : end + 1]) and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[end:]):
            raise LexError(at, "malformed number")
        if kind == "NUM" and re.match(r"0\d", value) and not re.search(r"[.eEjJ]", value) and value.strip("0_"):
            raise LexError(at, "malformed number")
        if kind == "NAME":
            kind = value if value in PYTHON_WORDS else "NAME"
        else:
            kind = value if kind == "OP" else kind
            if value in "([{":
                brackets.append(value)
            elif value in ")]}" and len(value) == 1:
                if not brackets or "([{".index(brackets.pop()) != ")]}".index(value):
                    raise LexError(at, "unmatched bracket")
        tokens.add(kind, value, False, at)
        at = end
    if brackets:
        raise LexError(n, "unclosed bracket")
    if not fresh and tokens.kinds:
        tokens.add("NEWLINE", "", False, n)
    for _ in indents[1:]:
        tokens.add("DEDENT", "", True, n)
    tokens.add("EOF", "", True, n)
    return tokens


PYTHON = Grammar(
    """
file = stmt* EOF
stmt = compound / simple
simple = small (";" small)* ";"? NEWLINE
small = "pass" / "break" / "continue" / "return" stars? / "raise" (expr ("from" expr)?)? / ("global" / "nonlocal") NAME % "," / "del" targets
  / "assert" expr ("," expr)? / "import" dotted_as % "," / "from" ("." / "...")* fromwhat / typealias / exprstmt
fromwhat = dotted? "import" ("*" / "(" name_as ("," name_as)* ","? ")" / name_as % ",")
dotted = NAME ("." NAME)*
dotted_as = dotted ("as" NAME)?
name_as = NAME ("as" NAME)?
typealias = 'type' NAME typeparams? "=" expr
exprstmt = (targets "=" !"=")+ (yieldexpr / stars) / tprim ":" expr ("=" (yieldexpr / stars))? / tprim augop (yieldexpr / stars) / yieldexpr / stars
augop = "+=" / "-=" / "*=" / "/=" / "//=" / "%=" / "@=" / "&=" / "|=" / "^=" / ">>=" / "<<=" / "**="
targets = target ("," target)* ","?
target = "*"? tprim
tprim = atom (trailer &trailer)* ("." NAME / "[" slices "]") / NAME / "(" targets? ")" / "[" targets? "]"
stars = star ("," star)* ","?
star = "*" bitor / named
named = NAME ":=" expr / expr
yieldexpr = "yield" ("from" expr / stars)?
expr = (NAME / NUM) &(")" / "," / NEWLINE / "]" / "}" / ":" / "=") / "lambda" lparams? ":" expr / disj ("if" disj "else" expr)?
disj = inversion (("and" / "or") inversion)*
inversion = "not"* comparison
comparison = bitor (compop bitor)*
compop = "==" / "!=" / "<=" / ">=" / "<" / ">" / "in" / "not" "in" / "is" "not" / "is"
bitor = unary (("+" / "-" / "*" / "/" / "//" / "%" / "@" / "&" / "|" / "^" / "<<" / ">>") unary)*
unary = ("-" / "+" / "~")* power
power = "await"? primary ("**" unary)?
primary = atom trailer*
trailer = "." NAME / "(" args? ")" / "[" slices "]"
args = arg ("," arg)* ","?
arg = NAME "=" expr / "**" expr / "*" expr / named compfor?
slices = slice ("," slice)* ","?
slice = expr? ":" expr? (":" expr?)? / star
atom = NAME / NUM / STR+ / "None" / "True" / "False" / "..." / "(" (yieldexpr / named compfor / stars)? ")" / "[" (star compfor / stars)? "]" / "{" (dictset)? "}"
dictset = expr ":" expr compfor / ditem ("," ditem)* ","? / star compfor / stars
ditem = "**" bitor / expr ":" expr
compfor = "async"? "for" targets "in" disj ("if" disj)* compfor?
lparams = lparam ("," lparam)* ","?
lparam = ("*" / "**") NAME / "*" / "/" / NAME ("=" expr)?
params = param ("," param)* ","?
param = "**" NAME (":" expr)? / "*" NAME (":" star)? / "*" / "/" / NAME (":" expr)? ("=" expr)?
block = NEWLINE INDENT stmt+ DEDENT / simple
compound = "if" named ":" block ("elif" named ":" block)* ("else" ":" block)? / "while" named ":" block ("else" ":" block)?
  / "for" targets "in" stars ":" block ("else" ":" block)? / try / "with" withitems ":" block / "async" asyncstmt / def / class / match / "@" named NEWLINE decorated
decorated = "@" named NEWLINE decorated / def / class / "async" def
asyncstmt = def / "for" targets "in" stars ":" block ("else" ":" block)? / "with" withitems ":" block
try = "try" ":" block (("except" "*"? (exceptwhat ("as" NAME)?)? ":" block)+ ("else" ":" block)? ("finally" ":" block)? / "finally" ":" block)
exceptwhat = expr
withitems = "(" withitem ("," withitem)* ","? ")" &":" / withitem % ","
withitem = expr ("as" target)?
def = "def" NAME typeparams? "(" params? ")" ("->" expr)? ":" block
class = "class" NAME typeparams? ("(" args? ")")? ":" block
typeparams = "[" (typeparam ("," typeparam)* ","?) "]"
typeparam = ("*" / "**")? NAME (":" expr)? ("=" star)?
match = 'match' subject ":" NEWLINE INDENT case+ DEDENT
subject = "*" bitor "," stars? / named ("," stars?)?
case = 'case' patterns ("if" named)? ":" block
patterns = pattern ("," pattern)* ","?
pattern = "*" NAME / closed ("|" closed)* ("as" NAME)?
closed = "-"? NUM (("+" / "-") NUM)? / STR+ / "None" / "True" / "False" / dotted ("(" (kwpattern ("," kwpattern)* ","?)? ")")? / "(" patterns? ")" / "[" patterns? "]" / "{" (mpattern ("," mpattern)* ","?)? "}"
kwpattern = NAME "=" pattern / pattern
mpattern = "**" NAME / ("-"? NUM / STR+ / "None" / "True" / "False" / dotted) ":" pattern
""",
    PYTHON_WORDS,
)

# ---- JavaScript and TypeScript

JS_WORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_VALUE_ENDS = {"NAME", "NUM", "STR", "TEMPLATE", "REGEX", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")


def _slash(text: str, at: int, end: int, tokens: Tokens) -> tuple[str, int]:
    if not tokens.kinds or tokens.kinds[-1] not in _VALUE_ENDS:
        m = _REGEX.match(text, at)
        if not m:
            raise LexError(at, "unterminated literal or comment")
        return "REGEX", m.end()
    value = "/=" if text.startswith("/=", at) else "/"
    return value, at + len(value)


JS_LEXER = Lexer(
    [
        ("SKIP", rf"{SPACE}|{C_COMMENT}|\A#![^\n]*"),
        ("BAD", r"/\*"),
        ("SLASH", r"/"),
        ("STR", r'"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|.))*\''),
        ("TEMPLATE", r"`"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:n|\.?(?:[eE][+-]?\d+)?))(?![\w$])"),
        ("NAME", r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*"),
        ("PRIV", r"#(?:[^\W\d]|\$)(?:\w|\$)*"),
        ("OP", r"\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|<<=|<<|<=|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~<>=?:;,.(){}\[\]@]"),
    ],
    JS_WORDS,
    {"SLASH": _slash, "TEMPLATE": lambda text, at, end, tokens: ("TEMPLATE", template_end(text, end, "`", "${"))},
)

_JS = """
file = stmt* EOF
semi = ";" / &"}" / &EOF / @nl
block = "{" stmt* "}"
stmt = block / ";" / ("var" / "const" !"enum") declr % "," semi / 'let' &(NAME / "[" / "{") declr % "," semi / if / for / "while" "(" exprs ")" stmt / "do" stmt "while" "(" exprs ")" ";"?
  / "continue" (@nonl NAME)? semi / "break" (@nonl NAME)? semi / "return" (@nonl exprs)? semi / "throw" @nonl exprs semi / switch / try / "with" "(" exprs ")" stmt
  / func / class / import / export / "debugger" semi / NAME ":" stmt / tsstmt / 'using' @nonl declr % "," semi / exprs semi
if = "if" "(" exprs ")" stmt ("else" stmt)?
for = "for" 'await'? "(" forhead ")" stmt
forhead = ("var" / "const" / 'let') binding typeann? ("in" / 'of') exprs / lhs ("in" / 'of') exprs / ((("var" / "const" / 'let') declr % ",") / exprs)? ";" exprs? ";" exprs?
switch = "switch" "(" exprs ")" "{" (("case" exprs / "default") ":" stmt*)* "}"
try = "try" block ("catch" ("(" binding typeann? ")")? block ("finally" block)? / "finally" block)
declr = binding bang? typeann? ("=" assign)?
binding = NAME / "{" (objbind ("," objbind)* ","?)? "}" / "[" ","* (arrbind ("," arrbind?)*)? "]"
objbind = "..." binding / propname ":" binding ("=" assign)? / NAME ("=" assign)?
arrbind = "..." binding / binding ("=" assign)?
func = ('async' @nonl)? "function" "*"? NAME? tparams? params rettype? (block / tssemi)
params = "(" (param ("," param)* ","?)? ")"
param = decorator* pmods "..."? (binding / thisname) optional? typeann? ("=" assign)?
decorator = "@" (primary trailer*)
exprs = assign % ","
assign = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / &( "(" / "<" / NAME ) arrow / 'yield' !("=" / "." / ")" / "," / ";") "*"? (@nonl assign)? / cond (aop assign)?
aop = "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "**=" / "&=" / "|=" / "^=" / "<<=" / "&&=" / "||=" / "??=" / ">" ">"? ">"? "="
arrow = ('async' @nonl)? (NAME / tparams? params rettype?) @nonl "=>" (block / assign)
cond = binary ("?" assign ":" assign)?
binary = unary (binop unary / tscast)*
binop = "+" / "-" / "*" / "/" / "%" / "**" / "==" / "!=" / "===" / "!==" / "<" / "<=" / "<<" / ">" ">" ">" !"=" / ">" ">" !"=" / ">" "="? / "&&" / "||" / "??" / "&" / "|" / "^" / "in" / "instanceof"
unary = ("!" / "~" / "+" / "-" / "++" / "--" / "typeof" / "void" / "delete" / 'await' !("=" / "." / ")" / "," / ";" / "=>"))* postfix (@nonl ("++" / "--"))?
lhs = primary trailer*
postfix = primary trailer*
primary = 'async' @nonl func / NAME / NUM / STR / TEMPLATE / REGEX / "this" / "null" / "true" / "false" / "super" / "(" exprs ")" / array / object / func / class / new / "import" (args / "." NAME) / PRIV
new = "new" ("." NAME / newtarget typeargs? args?)
newtarget = new / (NAME / "this" / "(" exprs ")" / func / class / "super" / array / "import" "." NAME) ("." pname / "[" exprs "]" / TEMPLATE)*
trailer = "." pname / "?." (pname / "[" exprs "]" / args) / "[" exprs "]" / args / TEMPLATE / tstrailer
pname = NAME / KW / PRIV
args = "(" (arg ("," arg)* ","?)? ")"
arg = "..."? assign
array = "[" ","* (arg ("," arg?)*)? "]"
object = "{" (prop ("," prop)* ","?)? "}"
prop = "..." assign / ('get' / 'set') propname params rettype? block / ('async' @nonl)? "*"? propname tparams? params rettype? block / propname ":" assign / NAME ("=" assign)?
propname = NAME / KW / STR / NUM / "[" assign "]" / PRIV
class = decorator* abstract? "class" (!("extends") !'implements' NAME)? tparams? ("extends" postfix typeargs?)? implements? "{" member* "}"
member = ";" / 'static' block / decorator* mod* (('get' / 'set') !("(" / "=" / ";" / "}" / ":") propname params rettype? (block / semi) / "*"? propname optional? tparams? params rettype? (block / tssemi) / propname (optional / bang)? typeann? ("=" assign)? semi / tsindex)
import = "import" (STR with? semi / tstype? imports 'from' STR with? semi / tsimport)
with = ("with" / 'assert') object
imports = NAME ("," (star / specs))? / star / specs
star = "*" "as_"
specs = "{" (spec ("," spec)* ","?)? "}"
spec = tstype? (NAME / KW / STR) (AS (NAME / KW / STR))?
export = "export" ("default" (func / class / tsdefault / assign semi) / "*" (AS (NAME / STR / KW))? 'from' STR with? semi / tstype? specs ('from' STR with?)? semi / tsexport / stmt)
"""
_JS = _JS.replace('"*" "as_"', "\"*\" 'as' NAME").replace("AS ", "'as' ")
_PLAIN = """
typeann = NEVER
tssemi = NEVER
bang = NEVER
tparams = NEVER
rettype = NEVER
pmods = NEVER?
thisname = NEVER
optional = NEVER
typeargs = NEVER
tscast = NEVER
tstrailer = NEVER
tsstmt = NEVER
tsindex = NEVER
tstype = NEVER
tsimport = NEVER
tsdefault = NEVER
tsexport = NEVER
abstract = NEVER
implements = NEVER
mod = ('static' / 'async' @nonl / 'accessor') !("(" / "=" / ";" / "}" / ",")
"""
_TYPED = """
typeann = ":" type
tssemi = semi
bang = "!"
tparams = "<" tparam ("," tparam)* ","? ">"
tparam = ("const" / "in" / 'out')* NAME ("extends" type)? ("=" type)?
rettype = ":" ("asserts_" / type)
pmods = (('public' / 'private' / 'protected' / 'readonly' / 'override') &(NAME / "{" / "["))*
thisname = "this"
optional = "?"
typeargs = "<" type ("," type)* ">"
tscast = ('as' / 'satisfies') ("const" / type)
tstrailer = "!" @nonl !"=" / typeargs &("(" / TEMPLATE) / typeargs &(")" / "," / ";" / "." / "]")
tsstmt = interface / alias / enum / 'declare' @nonl (namespace / stmt) / namespace / 'abstract' class / 'global' block
interface = 'interface' NAME tparams? ("extends" type % ",")? objtype
alias = 'type' NAME tparams? "=" type semi
enum = "const"? "enum" NAME "{" (enumitem ("," enumitem)* ","?)? "}"
enumitem = propname ("=" assign)?
namespace = ('namespace' / 'module') (STR / NAME ("." NAME)*) (block / semi)
tsindex = "[" NAME ":" type "]" typeann semi
tstype = 'type' !('from' STR) / "typeof"
tsimport = NAME "=" ('require' "(" STR ")" / NAME ("." NAME)*) semi
tsdefault = interface / 'abstract' class
tsexport = "=" assign semi / 'as' 'namespace' NAME semi / "import" tsimport
abstract = 'abstract'
implements = 'implements' type % ","
mod = ('static' / 'async' @nonl / 'accessor' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare') !("(" / "=" / ";" / "}" / "," / ":" / "?" / "!")
type = 'asserts' (NAME / "this") ('is' type)? / (NAME / "this") @nonl 'is' type / union ("extends" union "?" type ":" type)?
union = ("|" / "&")? operand (("|" / "&") operand)*
operand = (('keyof' / 'unique' / 'readonly' / 'infer') !("|" / "&" / ")" / "," / ";" / ">" / "=" / "[" / "]" / "}" / "."))* ptype (@nonl "[" type? "]")*
ptype = fntype / "(" type ")" / "-"? NUM / STR / TEMPLATE / "void" / "null" / "this" / "true" / "false" / "typeof" (NAME / "this" / "import" "(" STR ")") ("." pname)* typeargs? / "import" "(" STR ")" ("." NAME)* typeargs? / objtype / tuple / NAME ("." pname)* (@nonl typeargs)?
fntype = 'abstract'? "new"? tparams? params "=>" type
tuple = "[" (titem ("," titem)* ","?)? "]"
titem = "..."? (NAME "?"? ":" type / type "?"?)
objtype = "{" (tmember (";" / "," / &"}" / @nl))* "}"
tmember = mapped / tmod* ("new"? tparams? params rettype? / ('get' / 'set') propname params rettype? / propname "?"? tparams? params rettype? / propname "?"? typeann? / "[" NAME ":" type "]" typeann)
tmod = ('readonly' / "+" / "-") !(":" / "?" / "(" / ";" / "," / "}")
mapped = (("+" / "-")? 'readonly')? "[" NAME "in" type ('as' type)? "]" (("+" / "-")? "?")? typeann?
"""
_TYPED = _TYPED.replace('("asserts_" / type)', "type")

JAVASCRIPT = Grammar(_JS + _PLAIN, JS_WORDS)
TYPESCRIPT = Grammar(_JS + _TYPED, JS_WORDS)
