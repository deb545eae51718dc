"""Java, Go, C#, Rust and Kotlin."""

from __future__ import annotations

import re

from tessera.llm.lexing import C_COMMENT, NAME, SPACE, Lexer, LexError, Tokens, close_of
from tessera.llm.peg import Grammar

# ---- Java

JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JAVA_LEXER = Lexer(
    [
        ("SKIP", rf"{SPACE}|{C_COMMENT}"),
        ("BAD", r"/\*|\"\"\"(?!(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\")"),
        ("STR", r'"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n\r]|\\[^\n\r])*"'),
        ("CHAR", r"'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$])"),
        ("NAME", r"(?:[^\W\d]|\$)(?:\w|\$)*"),
        ("OP", r"\.\.\.|->|::|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"),
    ],
    JAVA_WORDS,
)
JAVA = Grammar(
    """
file = (annotation* "package" qname ";")? (import / ";")* (typedecl / ";" / member)* EOF
import = "import" "static"? NAME ("." NAME)* ("." "*")? ";"
qname = NAME ("." NAME)*
annotation = "@" !"interface" qname ("(" (annarg ("," annarg)* ","?)? ")")?
annarg = NAME "=" annvalue / annvalue
annvalue = annotation / "{" (annvalue ("," annvalue)*)? ","? "}" / ternary
mod = annotation / "public" / "private" / "protected" / "static" / "final" / "abstract" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default" !(":" / "->") / 'sealed' &(mod / "class" / "interface") / 'non' "-" 'sealed'
typedecl = mod* (class / interface / enum / record / annotationtype)
class = "class" NAME tparams? ("extends" type)? ("implements" type % ",")? ('permits' type % ",")? body
interface = "interface" NAME tparams? ("extends" type % ",")? ('permits' type % ",")? body
annotationtype = "@" "interface" NAME body
enum = "enum" NAME ("implements" type % ",")? "{" (enumconst ("," enumconst)*)? ","? (";" member*)? "}"
enumconst = annotation* NAME args? body?
record = 'record' NAME tparams? "(" formals? ")" ("implements" type % ",")? body
body = "{" member* "}"
member = ";" / "static"? block / typedecl / mod* tparams? (NAME formalsp throws? block / NAME block / typev NAME formalsp ("[" "]")* throws? (block / "default" annvalue ";" / ";") / typev declrs ";")
formalsp = "(" formals? ")"
formals = formal % ","
formal = mod* type annotation* "..."? ("this" / NAME "." "this" / NAME) ("[" "]")*
throws = "throws" type % ","
tparams = "<" (annotation* NAME ("extends" type ("&" type)*)?) % "," ">"
typev = "void" / type
type = annotation* (prim / NAME targs? ("." annotation* NAME targs?)*) (annotation* "[" "]")*
prim = "boolean" / "byte" / "char" / "short" / "int" / "long" / "float" / "double"
targs = "<" (targ % ",")? ">"
targ = annotation* "?" (("extends" / "super") type)? / type
declrs = declr % ","
declr = NAME ("[" "]")* ("=" init)?
init = "{" (init ("," init)*)? ","? "}" / expr
block = "{" bstmt* "}"
bstmt = localclass / localvar ";" / stmt
localclass = mod* (class / interface / enum / record)
localvar = mod* type declrs
stmt = block / ";" / "if" "(" expr ")" stmt ("else" stmt)? / "while" "(" expr ")" stmt / "do" stmt "while" "(" expr ")" ";" / "for" "(" forhead ")" stmt
  / "return" expr? ";" / "break" NAME? ";" / "continue" NAME? ";" / "throw" expr ";" / "synchronized" "(" expr ")" block / try / switch !("." / "::") / "assert" expr (":" expr)? ";" / 'yield' !("=" / "." / "(" / "++" / "--" / "[") expr ";" / NAME ":" stmt / exprstmt ";"
exprstmt = assignment / prepost / callish
assignment = unary aop expr
aop = "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">" ">"? "="
prepost = ("++" / "--") unary / primary ("++" / "--")
callish = base (suffix &suffix)* (args / "." targs? NAME args / "." new) / new
forhead = mod* type NAME ":" expr / (localvar / exprstmt % ",")? ";" expr? ";" (exprstmt % ",")?
try = "try" (resources block catch* finally? / block (catch+ finally? / finally))
resources = "(" resource (";" resource)* ";"? ")"
resource = mod* type NAME "=" expr / primary
catch = "catch" "(" mod* type ("|" type)* NAME ")" block
finally = "finally" block
switch = "switch" "(" expr ")" "{" (rule+ "}" / group* "}")
rule = label "->" (block / "throw" expr ";" / expr ";")
group = label ":" bstmt*
label = "case" ("null" ("," "default")? / pattern guard? / ternary % ",") / "default"
guard = 'when' expr
pattern = mod* type "(" (pattern % ",")? ")" NAME? / mod* type NAME
expr = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / lambda / assignment / ternary
lambda = (NAME / "(" (formals / NAME % ",")? ")") "->" (block / expr)
ternary = binary ("?" (lambda / ternary) ":" (lambda / ternary))?
binary = unary (binop unary / "instanceof" (pattern / mod* type))*
binop = "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<=" / "<<" / "<" / ">" ">" ">" !"=" / ">" ">" !"=" / ">" "=" / ">" / "+" / "-" / "*" / "/" / "%"
unary = ("+" / "-" / "++" / "--" / "!" / "~") unary / cast / primary ("++" / "--")*
cast = "(" prim ("[" "]")* ")" unary / "(" type ("&" type)* ")" (lambda / &(NAME / STR / CHAR / NUM / "(" / "!" / "~" / "this" / "super" / "new" / "true" / "false" / "null" / "switch" / prim / "void") unary)
primary = base suffix*
base = NUM / STR / CHAR / "true" / "false" / "null" / "this" / "super" / switch / new / (prim / NAME targs ("." NAME targs?)*) ("[" "]")* "::" ("new" / NAME) / prim ("[" "]")* "." "class" / "void" "." "class" / NAME ("[" "]")+ ("." "class" / "::" "new") / NAME / "(" expr ")"
suffix = "." targs? (NAME / "this" / "class" / "super" / new) / "[" expr "]" / args / "::" targs? ("new" / NAME)
args = "(" (expr % ",")? ")"
new = "new" annotation* targs? (prim / NAME targs? ("." NAME targs?)*) (("[" expr "]")+ ("[" "]")* / ("[" "]")+ "{" (init ("," init)*)? ","? "}" / args body?)
""",
    JAVA_WORDS,
)

# ---- Go

GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO = Lexer(
    [
        ("LINE", r"\n"),
        ("SKIP", r"[ \t\r﻿]+|//[^\n]*"),
        ("COMMENT", r"/\*(?:(?!\*/).)*\*/"),
        ("BAD", r"/\*"),
        ("STR", r'"(?:[^"\\\n]|\\.)*"|`[^`]*`'),
        ("CHAR", r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?(?!\w)"),
        ("NAME", NAME),
        ("OP", r"\.\.\.|<<=|>>=|&\^=|<-|:=|==|!=|<=|>=|&&|\|\||<<|>>|&\^|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!<>=~:;,.(){}\[\]]"),
    ],
    GO_WORDS,
)
_GO_ENDS = {"NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go_lexer(text: str) -> Tokens:
    """Tokens with the semicolons that line ends stand for."""
    raw, tokens = _GO(text), Tokens()
    for kind, value, at in zip(raw.kinds, raw.values, raw.offsets):
        if kind == "LINE" or kind == "EOF" or (kind == "COMMENT" and "\n" in value):
            if tokens.kinds and tokens.kinds[-1] in _GO_ENDS:
                tokens.add(";", "", True, at)
            if kind == "EOF":
                tokens.add("EOF", "", True, at)
        elif kind != "COMMENT":
            tokens.add(kind, value, False, at)
    return tokens


GO = Grammar(
    """
file = "package" NAME ";" (import ";")* (top ";")* EOF
import = "import" (importspec / "(" (importspec (";" importspec)* ";"?)? ")")
importspec = ("." / NAME)? STR
top = decl / func
decl = "const" (constspec / "(" (constspec (";" constspec)* ";"?)? ")") / "var" (varspec / "(" (varspec (";" varspec)* ";"?)? ")") / "type" (typespec / "(" (typespec (";" typespec)* ";"?)? ")")
constspec = names (type? "=" exprs)?
varspec = names (type ("=" exprs)? / "=" exprs)
typespec = NAME (tparams type / "="? type)
tparams = "[" tparam ("," tparam)* ","? "]"
tparam = names constraint
constraint = ("~"? type) ("|" "~"? type)*
names = NAME % ","
func = "func" receiver? NAME tparams? signature block?
receiver = params &NAME
signature = params (type / params)?
params = "(" (param ("," param)* ","?)? ")"
param = NAME "..."? type / "..."? type
type = "*" type / "[" "]" type / "[" ("..." / expr) "]" type / "map" "[" type "]" type / "chan" "<-"? type / "<-" "chan" type / "func" signature / struct / interface / "(" type ")" / NAME ("." NAME)? ("[" type ("," type)* ","? "]")?
struct = "struct" "{" (field (";" field)* ";"?)? "}"
field = (names type / "*"? NAME ("." NAME)? ("[" type % "," "]")?) STR?
interface = "interface" "{" (imember (";" imember)* ";"?)? "}"
imember = NAME signature / constraint
block = "{" stmts "}"
stmts = (stmt? ";")* stmt?
stmt = decl / NAME ":" !"=" stmt? / "go" primary / "defer" primary / "return" exprs? / "break" NAME? / "continue" NAME? / "goto" NAME / "fallthrough" / block / if / switch / select / for / simple
simple = exprs (":=" / aop) ("range" expr / exprs) / expr ("++" / "--" / "<-" expr)? 
aop = "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">>=" / "&^="
if = "if" (hsimple? ";")? hexpr block ("else" (if / block))?
switch = "switch" (typeswitch / (hsimple? ";")? hexpr?) "{" (case ":" stmts)* "}"
typeswitch = (hsimple ";")? (NAME ":=")? hprimary "." "(" "type" ")"
case = "case" (type / expr) % "," / "case" exprs / "default"
select = "select" "{" (("case" simple / "default") ":" stmts)* "}"
for = "for" (hrange / hsimple? ";" hexpr? ";" hsimple? / hexpr)? block
hrange = (hexpr % "," (":=" / "="))? "range" hexpr
hsimple = hexpr % "," (":=" / aop) hexpr % "," / hexpr ("++" / "--" / "<-" hexpr)?
exprs = expr % ","
expr = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / unary (binop unary)*
binop = "||" / "&&" / "==" / "!=" / "<" / "<=" / ">" / ">=" / "+" / "-" / "|" / "^" / "*" / "/" / "%" / "<<" / ">>" / "&" / "&^"
unary = ("+" / "-" / "!" / "^" / "*" / "&" / "<-") unary / primary
primary = operand suffix*
operand = "func" signature block / literal / NUM / STR / CHAR / conversion / NAME / "(" (expr / type) ")" / type &"("
conversion = ("[" "]" type / "map" "[" type "]" type / "chan" type / "*" type / "interface" "{" "}") "(" expr ","? ")"
suffix = "." (NAME / "(" ("type" / type) ")") / "[" (expr? ":" expr? (":" expr)? / (expr / type) ("," type)* ","?) "]" / "(" ((arg ("," arg)*) "..."? ","?)? ")" / litbody
arg = expr / type
literal = ("[" ("..." / expr)? "]" type / "map" "[" type "]" type / struct) litbody / NAME ("." NAME)? ("[" type % "," "]")? litbody
litbody = "{" (element ("," element)* ","?)? "}"
element = (litbody / expr) (":" (litbody / expr))?
hexpr = hunary (binop hunary)*
hunary = ("+" / "-" / "!" / "^" / "*" / "&" / "<-") hunary / hprimary
hprimary = hoperand (!litbody suffix / !"{" suffix)*
hoperand = "func" signature block / ("[" ("..." / expr)? "]" type / "map" "[" type "]" type) litbody / NUM / STR / CHAR / conversion / NAME / "(" (expr / type) ")"
""",
    GO_WORDS,
)

# ---- C#

CSHARP_WORDS = set(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)


def _interpolated(text: str, at: int, end: int, tokens: Tokens) -> tuple[str, int]:
    head = text[at:end]
    verbatim = "@" in head
    raw = re.match(r'\$+("{3,})', text[at:])
    if raw:
        stop = text.find(raw.group(1), at + raw.end())
        if stop < 0:
            raise LexError(at, "unterminated literal or comment")
        stop += len(raw.group(1))
        while text.startswith('"', stop):
            stop += 1
        return "STR", stop
    p = end
    while p < len(text):
        c = text[p]
        if c == '"':
            if verbatim and text.startswith('""', p):
                p += 2
                continue
            return "STR", p + 1
        if c == "\\" and not verbatim:
            p += 2
        elif c == "{":
            p = p + 2 if text.startswith("{{", p) else close_of(text, p + 1)
        elif c == "\n" and not verbatim:
            break
        else:
            p += 1
    raise LexError(at, "unterminated literal or comment")


CSHARP_LEXER = Lexer(
    [
        ("SKIP", rf"{SPACE}|{C_COMMENT}|(?m:(?<![^\n])[ \t]*#(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|warning|error|line)\b[^\n]*)"),
        ("BAD", r"/\*"),
        ("INTERP", r'(?:\$@|@\$|\$+(?="))"'),
        ("STR", r'@"(?:[^"]|"")*"|("{3,})(?:(?!\2).)*\2"*|"(?:[^"\\\n\r]|\\[^\n\r])*"(?:u8)?'.replace(r"\2", "(?P=RAW)").replace('("{3,})', '(?P<RAW>"{3,})')),
        ("CHAR", r"'(?:[^'\\\n\r]|\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.))'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)[uUlLfFdDmM]{0,2}(?!\w)"),
        ("NAME", rf"@?{NAME}"),
        ("OP", r"\?\?=|\?\?|\.\.|=>|->|::|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|\?\.|[-+*/%&|^!~<>=?:;,.(){}\[\]]"),
    ],
    CSHARP_WORDS,
    {"INTERP": _interpolated},
)
CSHARP = Grammar(
    """
file = ("extern" NAME NAME ";")* using* attrs* (nsfile / nsmember / bstmt)* EOF
using = 'global'? "using" "static"? "unsafe"? (NAME "=")? type ";"
nsfile = "namespace" qname ";" using*
nsmember = namespace / typedecl / using
namespace = attrs* "namespace" qname "{" using* nsmember* "}" ";"?
qname = NAME (("." / "::") NAME)*
attrs = "[" (NAME ":" / "return" ":" / "event" ":")? attr ("," attr)* ","? "]"
attr = qname targs? ("(" (attrarg % ",")? ")")?
attrarg = NAME ("=" / ":") expr / expr
mod = "public" / "private" / "protected" / "internal" / "static" / "sealed" / "abstract" / "virtual" / "override" / "readonly" / "const" / "extern" / "new" / "unsafe" / "volatile" / "ref" / "fixed" / 'async' &(mod / "void" / type) / 'partial' &(mod / "class" / "struct" / "interface" / "void" / 'record' / type) / 'required' &(mod / type) / 'file' &(mod / "class" / "struct" / "interface")
typedecl = attrs* mod* (class / enum / delegate)
class = ("class" / "struct" / "interface" / 'record' ("class" / "struct")?) NAME tparams? ("(" (param % ",")? ")")? (":" (type args?) % ",")? where* (body ";"? / ";")
where = 'where' NAME ":" (wherepart % ",")
wherepart = "new" "(" ")" / "class" "?"? / "struct" / "default" / type
tparams = "<" (attrs* ("in" / "out")? NAME) % "," ">"
body = "{" member* "}"
enum = "enum" NAME (":" type)? "{" (enumitem ("," enumitem)* ","?)? "}" ";"?
enumitem = attrs* NAME ("=" expr)?
delegate = "delegate" rtype NAME tparams? "(" (param % ",")? ")" where* ";"
member = typedecl / attrs* mod* membertail
membertail = "~" NAME "(" ")" mbody / NAME "(" (param % ",")? ")" (":" ("base" / "this") args)? mbody / ("implicit" / "explicit") "operator" "checked"? type "(" param % "," ")" mbody
  / "event" type (NAME ("=" expr)?) % "," ";" / "event" type mname accessors / rtype "operator" "checked"? op "(" param % "," ")" mbody / rtype mthis "[" param % "," "]" (accessors / "=>" expr ";")
  / rtype mname tparams? "(" (param % ",")? ")" where* mbody / rtype mname (accessors ("=" expr ";")? / "=>" expr ";") / type (NAME ("[" expr "]")? ("=" init)?) % "," ";"
mthis = (qname targs? ".")? "this"
op = "+" / "-" / "*" / "/" / "%" / "==" / "!=" / "<=" / "<<" / "<" / ">" ">" ">" / ">" ">" / ">" "=" / ">" / "!" / "~" / "++" / "--" / "true" / "false" / "&" / "|" / "^"
mname = NAME targs? (("." / "::") NAME targs?)*
mbody = block / "=>" expr ";" / ";"
accessors = "{" accessor+ "}"
accessor = attrs* mod* ('get' / 'set' / 'init' / 'add' / 'remove') mbody
param = attrs* ("this" / "ref" / "out" / "in" / "params" / "readonly" / 'scoped')* type NAME ("=" expr)?
rtype = "ref" "readonly"? type / "void" / type
type = typecore ("?" !(expr ":") / "*" / "[" ","* "]" / "?" &("[" / NAME / ">" / ")" / "," / "{" / ";" / "="))*
typecore = "object" / "string" / "bool" / "byte" / "sbyte" / "char" / "decimal" / "double" / "float" / "int" / "uint" / "long" / "ulong" / "short" / "ushort" / "void" "*" / "(" titem ("," titem)+ ")" / "delegate" "*" targs / NAME targs? (("." / "::") NAME targs?)*
titem = type NAME?
targs = "<" ","* ">" / "<" (attrs* type) % "," ">"
block = "{" bstmt* "}"
bstmt = localfunc / declstmt / stmt
localfunc = attrs* mod* rtype NAME tparams? "(" (param % ",")? ")" where* (block / "=>" expr ";")
declstmt = ('await' "using" / "using" / "const" / "ref" "readonly"? / 'scoped')? type declr % "," ";" / "fixed" "(" type declr % "," ")" bstmt
declr = NAME ("=" init)?
init = "{" (init ("," init)* ","?)? "}" / "ref" expr / "stackalloc" type ("[" expr? "]")? ("{" (expr % ",")? "}")? / expr
stmt = block / ";" / "if" "(" expr ")" estmt ("else" estmt)? / "while" "(" expr ")" estmt / "do" estmt "while" "(" expr ")" ";" / "for" "(" (type declr % "," / expr % ",")? ";" expr? ";" (expr % ",")? ")" estmt
  / 'await'? "foreach" "(" (("ref" "readonly"?)? type (NAME / tuplevars) / tupledecl) "in" expr ")" estmt / "switch" "(" expr ("," expr)* ")" "{" (label+ bstmt*)* "}" / "return" ("ref"? expr)? ";" / "break" ";" / "continue" ";" / "goto" ("case" expr / "default" / NAME) ";"
  / "throw" expr? ";" / 'yield' ("return" expr / "break") ";" / "try" block (catch+ ("finally" block)? / "finally" block) / "lock" "(" expr ")" estmt / 'await'? "using" "(" (type declr % "," / expr) ")" estmt / ("checked" / "unchecked" / "unsafe") block / NAME ":" bstmt / exprstmt ";"
estmt = stmt
tuplevars = "(" NAME ("," NAME)+ ")"
tupledecl = "(" (type NAME) ("," type NAME)+ ")"
label = "case" pattern ('when' expr)? ":" / "default" ":"
catch = "catch" ("(" type NAME? ")")? ('when' "(" expr ")")? block
exprstmt = unary aop expr / ("++" / "--" / 'await') unary / primary ("++" / "--") / callish / new
callish = base (suffix &suffix)* (args / "." NAME targs? args / "?." NAME targs? args / "!" )
expr = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / lambda / assignment / "throw" expr / "ref" expr / cond
assignment = (tupledecl / unary) aop expr
aop = "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / "??=" / ">" ">" ">"? "="
lambda = attrs* ("static" / 'async')* (NAME / rtype? "(" (lparam % ",")? ")") "=>" (block / expr) / ("static" / 'async')* "delegate" ("(" (param % ",")? ")")? block
lparam = param / ("ref" / "out" / "in")? NAME
cond = binary ("?" expr ":" expr)?
binary = unary (binop unary / "is" pattern / "as" type / switchx / 'with' "{" (NAME "=" expr) % ","  ","? "}")*
switchx = "switch" "{" (pattern ('when' expr)? "=>" expr) % "," ","? "}" / "switch" "{" "}"
binop = "??" / "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<=" / "<<" / "<" / ">" ">" ">" !"=" / ">" ">" !"=" / ">" "=" / ">" / "+" / "-" / "*" / "/" / "%" / ".."
unary = ("+" / "-" / "!" / "~" / "++" / "--" / "&" / "*" / "^" / ".." / 'await' !("=" / "." / ")" / "," / ";")) unary / cast / primary ("++" / "--" / "..")*
cast = "(" type ")" &(NAME / STR / CHAR / NUM / "(" / "!" / "~" / "this" / "base" / "new" / "true" / "false" / "null" / "default" / "typeof" / "string" / "object" / "int" / "checked") unary
primary = base suffix*
base = NUM / STR / CHAR / "true" / "false" / "null" / "this" / "base" / new / "typeof" "(" ("void" / type) ")" / "sizeof" "(" type ")" / "default" ("(" type ")")? / ("checked" / "unchecked") "(" expr ")" / "stackalloc" type? "[" expr? "]" objinit? / "(" (NAME ":")? expr ("," (NAME ":")? expr)+ ")" / "(" expr ")" / "[" (("..")? expr % "," ","?)? "]"
  / ("object" / "string" / "bool" / "byte" / "sbyte" / "char" / "decimal" / "double" / "float" / "int" / "uint" / "long" / "ulong" / "short" / "ushort") &"." / NAME (targs &("(" / "." / ")" / "," / ";" / ">" / "}" / "]"))? ("::" NAME)?
suffix = "." NAME (targs &("(" / "." / ")" / "," / ";" / ">" / "}" / "]"))? / "?." NAME targs? / "?" &"[" "[" arg % "," "]" / "[" arg % "," "]" / args / "!" !"=" / "->" NAME
args = "(" (arg % ",")? ")"
arg = (NAME ":")? ("out" (type NAME / expr) / ("ref" / "in") expr / expr)
new = "new" (args objinit? / ("[" ","* "]" arrinit) / objinit / typecore "?"? ("[" (expr % ",")? ","* "]")+ arrinit? / type args? objinit?)
arrinit = "{" (init ("," init)* ","?)? "}"
objinit = "{" (objitem ("," objitem)* ","?)? "}"
objitem = ("[" arg % "," "]" / NAME) "=" (objinit / expr) / "{" expr % "," "}" / expr
pattern = patand ('or' patand)*
patand = patnot ('and' patnot)*
patnot = 'not' patnot / patbase
patbase = ("<=" / "<" / ">" "="? ) binaryp / 'var' (NAME / tuplevars) / '_' !("." / "<") / "[" (pattern % ",")? "]" NAME? / ".." pattern? / type? "(" (pattern1 % ",")? ")" propp? NAME? / type? propp NAME? / type !('or' / 'and' / 'when') NAME &( ")" / "=>" / ":" / "&&" / "||" / "?" / 'when' / 'and' / 'or' / "," / ";" / "}" / "]" ) / binaryp / type
pattern1 = (NAME ":")? pattern
propp = "{" ((qname ":" pattern) ("," qname ":" pattern)* ","?)? "}"
binaryp = unary (("+" / "-" / "*" / "/" / "|" / "&" / "<<") unary)*
""",
    CSHARP_WORDS,
)

# ---- Rust

RUST_WORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())


def _rust_comment(text: str, at: int, end: int, tokens: Tokens) -> tuple[str, int]:
    depth, scan = 1, re.compile(r"/\*|\*/")
    while depth:
        m = scan.search(text, end)
        if not m:
            raise LexError(at, "unterminated literal or comment")
        depth += 1 if m.group() == "/*" else -1
        end = m.end()
    return "SKIPPED", end


class _RustLexer(Lexer):
    def __call__(self, text: str) -> Tokens:
        raw, tokens = super().__call__(text), Tokens()
        for row in zip(raw.kinds, raw.values, raw.breaks, raw.offsets):
            if row[0] != "SKIPPED":
                tokens.add(*row)
        return tokens


RUST_LEXER = _RustLexer(
    [
        ("SKIP", rf"{SPACE}|//[^\n]*|\A#![^\[][^\n]*"),
        ("NEST", r"/\*"),
        ("STR", r'(?:b|c)?r(?P<HASH>#*)".*?"(?P=HASH)|[bc]?"(?:[^"\\]|\\.)*"'),
        ("CHAR", r"b?'(?:[^'\\\n\r\t]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[^\n]))'"),
        ("LIFE", rf"'{NAME}"),
        ("NUM", r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)"),
        ("NAME", rf"(?:r\#)?{NAME}"),
        ("OP", r"\.\.=|\.\.\.|\.\.|::|->|=>|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^!<>=?:;,.(){}\[\]@#$~]"),
    ],
    RUST_WORDS,
    {"NEST": _rust_comment},
)
RUST = Grammar(
    """
file = inner* item* EOF
inner = "#" "!" "[" tree* "]"
outer = "#" "[" tree* "]"
tree = "(" tree* ")" / "[" tree* "]" / "{" tree* "}" / !(")" / "]" / "}" / EOF) ANY_
vis = "pub" ("(" ("crate" / "self" / "super" / "in" path) ")")?
item = outer* vis? (use / fn / struct / enum / union / impl / trait / mod / const / static / typealias / externblock / externcrate / macrorules / macroitem)
use = "use" usetree ";"
usetree = "::"? ("*" / "{" (usetree ("," usetree)* ","?)? "}" / useseg ("::" useseg)* ("::" ("*" / "{" (usetree ("," usetree)* ","?)? "}") / "as" NAME)?)
useseg = NAME / "crate" / "self" / "super" / "Self"
fn = ("const" / "async" / "unsafe" / "extern" STR?)* "fn" NAME generics? "(" fnparams? ")" ("->" type)? where? (block / ";")
fnparams = fnparam ("," fnparam)* ","?
fnparam = outer* ("..." / ("&" LIFE?)? "mut"? "self" (":" type)? / pattern ":" type)
generics = "<" (generic ("," generic)* ","?)? ">"
generic = outer* (LIFE (":" (LIFE ("+" LIFE)*)?)? / "const" NAME ":" type ("=" (block / "-"? NUM / NAME))? / NAME (":" bounds?)? ("=" type)?)
bounds = bound ("+" bound)* "+"?
bound = LIFE / "(" bound ")" / ("~"? "const")? "?"? forlife? path
forlife = "for" generics
where = "where" (whereitem ("," whereitem)* ","?)?
whereitem = LIFE ":" bounds? / forlife? type ":" bounds?
struct = "struct" NAME generics? (where? fields / "(" (tfield ("," tfield)* ","?)? ")" where? ";" / where? ";")
fields = "{" (field ("," field)* ","?)? "}"
field = outer* vis? NAME ":" type
tfield = outer* vis? type
enum = "enum" NAME generics? where? "{" (variant ("," variant)* ","?)? "}"
variant = outer* vis? NAME (fields / "(" (tfield ("," tfield)* ","?)? ")")? ("=" expr)?
union = 'union' NAME generics? where? fields
impl = "unsafe"? "impl" generics? "const"? "!"? type ("for" type)? where? "{" inner* assoc* "}"
assoc = outer* vis? 'default'? (fn / const / typealias / macroitem)
trait = "unsafe"? 'auto'? "trait" NAME generics? (":" bounds?)? where? "{" inner* assoc* "}"
mod = "unsafe"? "mod" NAME (";" / "{" inner* item* "}")
const = "const" NAME ":" type ("=" expr)? ";"
static = "static" "mut"? NAME ":" type ("=" expr)? ";"
typealias = "type" NAME generics? (":" bounds?)? where? ("=" type)? where? ";"
externblock = "unsafe"? "extern" STR? "{" inner* (outer* vis? (fn / static / typealias / macroitem))* "}"
externcrate = "extern" "crate" (NAME / "self") ("as" NAME)? ";"
macrorules = 'macro_rules' "!" NAME ("(" tree* ")" ";" / "[" tree* "]" ";" / "{" tree* "}")
macroitem = path "!" NAME? ("(" tree* ")" ";" / "[" tree* "]" ";" / "{" tree* "}" ";"?)
type = ("&" / "&&") LIFE? "mut"? type / "*" ("const" / "mut") type / "[" type (";" expr)? "]" / "(" (type ("," type)* ","?)? ")" / "!" / "impl" bounds / "dyn" bounds / forlife? ("unsafe" / "extern" STR?)* "fn" "(" (ftype ("," ftype)* ","?)? ")" ("->" type)? / path "!" delim / "<" type ("as" path)? ">" ("::" pathseg)+ / path ("+" bound)* 
ftype = (NAME ":")? type / "..."
path = "::"? pathseg ("::" pathseg)*
pathseg = (NAME / "crate" / "self" / "super" / "Self") ("::"? gargs / "(" (type ("," type)* ","?)? ")" &("->" / "+" / "," / ">" / "{" / ";" / ")" / "=") ("->" type)?)?
gargs = "<" (garg ("," garg)* ","?)? ">"
garg = LIFE / NAME gargs? ("=" type / ":" bounds) / type / block / "-"? NUM / STR / "true" / "false"
delim = "(" tree* ")" / "[" tree* "]" / "{" tree* "}"
pattern = "|"? pat ("|" pat)*
pat = ("&" / "&&") "mut"? pat / "ref"? "mut"? NAME !("::" / "(" / "{" / "!" / ".." / "..=") ("@" pat)? / "ref" "mut"? NAME ("@" pat)? / "(" (pattern ("," pattern)* ","?)? ")" / "[" (pattern ("," pattern)* ","?)? "]" / range / epath ("(" (pattern ("," pattern)* ","?)? ")" / "{" (fpat ("," fpat)* ","?)? "}") / path "!" delim / '_' / ".." / epath
range = value (("..=" / ".." / "...") lit?)? / epath ("..=" / "..") lit? / ("..=" / "..") lit
value = "-"? NUM / STR / CHAR / "true" / "false"
lit = value / epath
fpat = outer* (".." / (NAME / NUM) ":" pattern / "ref"? "mut"? NAME)
epath = "<" type ("as" path)? ">" ("::" eseg)+ / "::"? eseg ("::" eseg)*
eseg = (NAME / "crate" / "self" / "super" / "Self") ("::" gargs)?
block = "{" inner* stmts "}"
stmts = stmt* expr?
stmt = ";" / outer* let / item / blocklike !("." / "?") / macrostmt / outer* expr ";" / outer* blocklike
let = "let" pattern (":" type)? ("=" expr ("else" block)?)? ";"
macrostmt = path "!" "{" tree* "}" !("." / "?")
blocklike = (LIFE ":")? (block / "unsafe" block / if / match / "loop" block / "while" cond block / "for" pattern "in" nexpr block) / "async" "move"? block / "const" block
if = "if" cond block ("else" (if / block))?
cond = letcond ("&&" letcond)* / nexpr
letcond = "let" pattern "=" nbin / nbin &("&&" / "{")
match = "match" nexpr "{" inner* arm* "}"
arm = outer* pattern ("if" guard)? "=>" (blocklike ","? !("." / "?" / binop) / expr ("," / &"}"))
guard = letcond2 ("&&" letcond2)* / expr
letcond2 = "let" pattern "=" unary / unary
expr = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / "return" expr? / "break" LIFE? expr? / "continue" LIFE? / closure / assign
closure = ("for" generics)? ("static" / "async" / "move" / "const")* ("||" / "|" (cparam ("," cparam)* ","?)? "|") ("->" type block / expr)
cparam = outer* pat (":" type)?
assign = rangex (aop expr)?
aop = "=" / "+=" / "-=" / "*=" / "/=" / "%=" / "&=" / "|=" / "^=" / "<<=" / ">" ">" "="
rangex = binary ((".." / "..=") binary?)? / (".." / "..=") binary?
binary = unary (binop (closure / unary) / "as" type)*
binop = "||" / "&&" / "|" / "^" / "&" / "==" / "!=" / "<=" / "<<" / "<" / ">" ">" !"=" / ">" "=" / ">" / "+" / "-" / "*" / "/" / "%"
unary = ("-" / "!" / "*" / ("&" / "&&") ('raw' ("const" / "mut") / "mut")?) unary / postfix
postfix = primary suffix*
primary = NUM / STR+ / CHAR / "true" / "false" / blocklike / path "!" delim / epath structbody? / "(" (expr ("," expr)* ","?)? ")" / "[" (expr (";" expr / ("," expr)* ","?))? "]" / closure / "return" expr? / "break" LIFE? expr? / "continue" LIFE?
structbody = "{" (fexpr ("," fexpr)* ","?)? "}"
fexpr = outer* (".." expr? / (NAME / NUM) ":" expr / NAME)
suffix = "?" / "." ("await" / NUM / NAME ("::" gargs)?) / "(" (expr ("," expr)* ","?)? ")" / "[" expr "]"
nexpr = nrange (aop nrange)?
nrange = nbin ((".." / "..=") nbin?)? / (".." / "..=") nbin?
nbin = nunary (!("&&" "let") binop (closure / nunary) / "as" type)*
nunary = ("-" / "!" / "*" / ("&" / "&&") "mut"?) nunary / nprimary suffix*
nprimary = NUM / STR+ / CHAR / "true" / "false" / (LIFE ":")? ("unsafe" block / if / match / "loop" block) / block / path "!" delim / epath / "(" (expr ("," expr)* ","?)? ")" / "[" (expr (";" expr / ("," expr)* ","?))? "]" / closure
""".replace("ANY_", "ANY"),
    RUST_WORDS,
)

# ---- Kotlin

KOTLIN_WORDS = set("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split())


def _kotlin_string(text: str, at: int, end: int, tokens: Tokens) -> tuple[str, int]:
    p = end
    while p < len(text):
        c = text[p]
        if c == '"':
            return "STR", p + 1
        if c == "\\":
            p += 2
        elif text.startswith("${", p):
            p = close_of(text, p + 2)
        elif c == "\n":
            break
        else:
            p += 1
    raise LexError(at, "unterminated literal or comment")


def _kotlin_raw(text: str, at: int, end: int, tokens: Tokens) -> tuple[str, int]:
    stop = text.find('"""', end)
    if stop < 0:
        raise LexError(at, "unterminated literal or comment")
    stop += 3
    while text.startswith('"', stop):
        stop += 1
    return "STR", stop


KOTLIN_LEXER = _RustLexer(
    [
        ("SKIP", rf"{SPACE}|//[^\n]*|\A#![^\n]*"),
        ("NEST", r"/\*"),
        ("RAW", r'"""'),
        ("QUOTE", r'"'),
        ("CHAR", r"'(?:[^'\\\n\r]|\\(?:u[0-9a-fA-F]{4}|.))'"),
        ("NUM", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)[uULfF]{0,2}(?!\w)"),
        ("NAME", rf"{NAME}|`[^`\n]+`"),
        ("OP", r"\.\.<|\.\.|===|!==|->|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\?:|\?\.|::|!!|[-+*/%&|!<>=?:;,.(){}\[\]@#]"),
    ],
    KOTLIN_WORDS,
    {"NEST": _rust_comment, "RAW": _kotlin_raw, "QUOTE": _kotlin_string},
)
KOTLIN = Grammar(
    """
file = annotation* ("package" qname semi)? ("import_" qname ("." "*" / "as" NAME)? semi)* (decl semi)* EOF
semi = ";"+ / @nl / &EOF / &"}"
qname = NAME ("." NAME)*
annotation = "@" (NAME ":")? ("[" (utype args?)+ "]" / utype (@nonl args)?)
utype = NAME targs? ("." NAME targs?)*
mod = annotation / ('public' / 'private' / 'protected' / 'internal' / 'open' / 'abstract' / 'final' / 'sealed' / 'data' / 'enum' / 'inner' / 'value' / 'annotation' / 'companion' / 'override' / 'lateinit' / 'const' / 'suspend' / 'inline' / 'infix' / 'operator' / 'tailrec' / 'external' / 'noinline' / 'crossinline' / 'vararg' / 'expect' / 'actual' / "in" / 'out' / 'reified') &(NAME / "class" / "interface" / "fun" / "val" / "var" / "object" / "@" / "typealias")
decl = mod* (class / object / fun / property / "typealias" NAME tparams? "=" type)
class = ("class" / "fun"? "interface") NAME tparams? (mod* 'constructor'? "(" (cparam ("," cparam)* ","?)? ")")? (":" supers)? where? (body)?
cparam = mod* ("val" / "var")? NAME ":" type ("=" expr)?
supers = superspec % ","
superspec = annotation* (utype args / type ("by_" expr)?)
object = "object" NAME? (":" supers)? body?
body = "{" enumentries? (member semi)* "}"
enumentries = enumentry ("," enumentry)* ","? (";" / &"}")
enumentry = annotation* NAME args? body? &("," / ";" / "}")
member = mod* 'constructor' fparams (":" ("this" / "super") args)? block? / 'init' block / mod* 'companion' "object" NAME? (":" supers)? body? / decl / ";"
fun = "fun" tparams? (rtype ".")? NAME fparams (":" type)? where? ("=" expr / block)?
rtype = "(" type ")" "?"? / NAME targs? "?"? ("." NAME targs? "?"? &".")*
fparams = "(" (fparam ("," fparam)* ","?)? ")"
fparam = mod* NAME ":" type ("=" expr)?
where = 'where' (annotation* NAME ":" type) % ","
property = ("val" / "var") tparams? (rtypep ".")? (NAME (":" type)? / "(" vars ")") where? ("=" expr / "by_" expr)? ";"? (getset ";"?)*
rtypep = NAME targs? "?"? &("." NAME)
vars = (annotation* NAME (":" type)?) ("," NAME (":" type)?)* ","?
getset = mod* ('get' / 'set') !("=" NAME "(" NEVER) ("(" (NAME (":" type)?)? ")" (":" type)? ("=" expr / block))?  
tparams = "<" (tparam ("," tparam)* ","?) ">"
tparam = mod* NAME (":" type)?
targs = "<" (targ ("," targ)* ","?) ">"
targ = "*" / ("in" / 'out')? type
type = annotation* 'suspend'? typecore "?"* ("&" type)?
typecore = (rtypef ".")? "(" (ftype ("," ftype)* ","?)? ")" "->" type / "(" type ")" / NAME targs? ("." NAME targs?)*
rtypef = NAME targs? "?"?
ftype = (NAME ":")? type
block = "{" stmts "}"
stmts = ";"* (stmt semi)* 
stmt = NAME "@" stmt / annotation* (decl / loop / assign / expr)
assign = target ("=" / "+=" / "-=" / "*=" / "/=" / "%=") expr
target = prefix
loop = "for" "(" annotation* (NAME (":" type)? / "(" vars ")") "in" expr ")" (control / ";") / "while" "(" expr ")" (control / ";") / "do" control? "while" "(" expr ")"
control = block / stmt
expr = (NAME / NUM / STR) &(")" / "," / ";" / "]" / "}") / disj
disj = operand (@nonl binop operand / elvis operand / infix operand / @nonl ("is" / "!" "is") type / @nonl ("as" "?"?) type / logic operand)*
binop = "<" / ">" / "<=" / ">=" / "==" / "!=" / "===" / "!==" / "+" / "-" / "*" / "/" / "%" / ".." / "..<" / "in" / "!" "in"
elvis = "?:"
logic = "&&" / "||"
infix = @nonl NAME !("(" ")" NEVER)
operand = prefix
prefix = (annotation / NAME "@" / "-" / "+" / "++" / "--" / "!")* postfix
postfix = primary suffix*
suffix = (@nonl ("++" / "--" / "!!")) / @nonl targs? args lambda? / @nonl targs? lambda / @nonl "[" (expr ("," expr)* ","?) "]" / ("." / "?." / "::") ("class" / NAME / "(" expr ")") / @nonl targs &("::" / "." / "(") / @nonl "?" &"::"
args = "(" (arg ("," arg)* ","?)? ")"
arg = annotation* (NAME "=" !"=")? "*"? expr
lambda = annotation* (NAME "@")? "{" (lparams? "->")? stmts "}"
lparams = lparam ("," lparam)* ","?
lparam = NAME (":" type)? / "(" vars ")" (":" type)?
primary = NUM / STR / CHAR / "true" / "false" / "null" / "this" ("@" NAME)? / "super" ("<" type ">")? ("@" NAME)? / if / when / try / "object" (":" supers)? body / lambda / afun / "throw" expr / "return" ("@" NAME)? (@nonl expr)? / "break" ("@" NAME)? / "continue" ("@" NAME)? / "::" NAME / "(" expr ")" / "[" (expr ("," expr)* ","?)? "]" / NAME
afun = "fun" (rtype ".")? fparams (":" type)? ("=" expr / block)
if = "if" "(" expr ")" (";"? "else" control / (control / ";") (";"? "else" (control / ";"))?)
when = "when" ("(" (annotation* "val" NAME (":" type)? "=")? expr ")")? "{" (wentry semi)* "}"
wentry = (("else" / wcond ("," wcond)* ","?) ("if" expr)? "->" control)
wcond = ("in" / "!" "in") expr / ("is" / "!" "is") type / expr
try = "try" block (catch+ ("finally" block)? / "finally" block)
catch = 'catch' "(" annotation* NAME ":" type ","? ")" block
""".replace('"import_"', "'import'").replace('"by_"', "'by'").replace('"finally"', "'finally'"),
    KOTLIN_WORDS,
)
