"""Documentation pairs, packing, leakage and reading levels."""

import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import leakage
from tessera.llm.docpairs import assign, informative, pair_documentation
from tessera.llm.leakage import Index, covered, find_leaks, leaked_items, leaks, tiles, words_of
from tessera.llm.packing import TOKENIZER, _encoding, first_fit_decreasing, pack_documents, pack_fill, token_counts
from tessera.llm.reading import demanding, prose, reading_levels, train

SF = "/root/testdata/sf0.1"


def test_what_says_something():
    sig = "def lock_cursor(cursor, limit)"
    for text in ("Waits for the last reader.", "Half-open range, in days.", "O(log n) in rows.", "Teilt den Bestand in Fenster.", "@param limit rows that were fixed before noon", "TODO: tune. Never blocks on readers.", "返回所有未关闭的订单"):
        assert informative(text, "lock_cursor", sig), text
    for text in (None, "", "TODO", "Locks the cursor.", "lock_cursor()", "This function is used to lock the cursor.", "@param cursor the cursor", ":param limit:\n:return:", "noqa: D103", "{@inheritDoc}", "Auto-generated method stub", "/** - */", "Args:\n    cursor:\n\nReturns:\n"):
        assert not informative(text, "lock_cursor", sig), text


def test_one_word_in_a_condition_says_something():
    sig = "def first_of(items)"
    for text in ("Throws an error if the list is empty.", "Returns null if missing.", "@throws Error on overflow", "Returns the first of the items unless closed."):
        assert informative(text, "first_of", sig), text
    for text in ("Returns the items if given.", "Throws an exception.", "@throws IOException", "Returns null.", "Gets the first of the items.", "Returns the gadget."):
        assert not informative(text, "first_of", sig), text


def test_assignment_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randrange(1, 5), r.randrange(1, 5)
        w = {(f, c): round(r.random(), 3) for f in range(n) for c in range(m) if r.random() < 0.7}
        got = sum(w[f, c] for f, c in assign(w, n, m).items())
        best = 0.0
        for cs in itertools.permutations([*range(m), *[None] * n], n):
            best = max(best, sum(w.get((f, c), 0.0) for f, c in enumerate(cs) if c is not None))
        assert abs(got - best) < 1e-9


def test_pairs_of_a_frame(spark):
    s = "id long, file_id long, kind string, name string, qualified_name string, start_line int, signature string, docstring string, key int"
    doc = "Waits for the last reader."
    rows = [
        (1, 1, "function", "f", "m.f", 1, "def f(a)", doc, 0), (2, 1, " Method ", "g", "m.g", 9, "def g(b)", doc, 0), (3, 1, "function", "h", "m.h", 20, " ", doc, 0),
        (4, 1, "constructor", "C", "m.C", 30, "C()", doc, 0), (5, 1, "function", "i", "m.i", 40, "def i()", "TODO", 0), (6, None, "function", "j", None, None, "def j()", doc, 0),
        (7, 1, "function", "f", "m.f", 1, "def f(a)", doc, 0), (8, 2, "function", "k", "m.k", 1, None, doc, 0), (9, 2, None, "k", "m.k", 1, "def k()", doc, 0),
    ]
    df = spark.createDataFrame(rows, s)
    assert sorted(r.symbol_id for r in pair_documentation(df).collect()) == [1, 2, 6, 7]
    assert pair_documentation(df.limit(0)).count() == 0


def test_first_fit_decreasing_equals_the_plain_one():
    r = random.Random(1)
    for _ in range(40):
        sizes = [r.randrange(1, 11) for _ in range(r.randrange(0, 40))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if b == len(room):
                room.append(10)
            room[b] -= sizes[i]
            want[i] = b
        assert first_fit_decreasing(sizes, 10) == want


def test_packs_hold_every_document_once(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.choice([1, 30, 90, 400]))), 1) for i in range(200)] + [(900, None, 1), (901, "", 1), (902, "<|endoftext|>", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    sizes = {x.doc_id: x.n_tokens for x in token_counts(df).collect()}
    assert sizes[900] == sizes[901] == 0 and sizes[902] > 1
    packs = pack_documents(df, capacity=100, group_packs=50)
    got = packs.collect()
    total, room = {}, {}
    for x in got:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
        if x.pack_id is not None:
            room[x.pack_id] = room.get(x.pack_id, 0) + x.n_tokens
    assert total == sizes and max(room.values()) <= 100
    assert all(sizes[x.doc_id] > 100 for x in got if x.piece > 0)
    assert pack_fill(packs, 100).first().used > 0.9
    assert pack_documents(df.limit(0)).count() == 0


def test_tokens_are_those_of_the_public_pattern():
    import public_tokenizers
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_encoding(TOKENIZER)._mergeable_ranks, special_tokens={})
    for text in ("It's  a\n\n test,\t1234 é你好  ", "x" * 3000, "   \n  "):
        assert plain.encode_ordinary(text) == _encoding(TOKENIZER).encode_ordinary(text)


ITEM = "the relay report from venhap loses its daily mailbag whenever tuldul starts to sample a window find the cause and match it with care. Answer in one line."
OTHER = "the floor report from sabgor loses its dense visitor whenever pelmur starts to append a floor find the cause and save it. Answer in one line."


def found(*texts, items=((1, ITEM), (2, OTHER))):
    shared = {"answer in one line"}
    return [(d, i) for d, i, _ in leaks(list(texts), Index(list(items), shared))]


def test_leaks_whole_in_part_and_changed():
    words = words_of(ITEM)[:26]
    changed = [w if i % 9 else "xx" for i, w in enumerate(words)]
    assert found("before it " + " ".join(words) + " after it") == [(0, 1)]
    assert found("**" + " ".join(words[:12]) + "** and then something else entirely " + " ".join(words[13:26])) == [(0, 1)]
    assert found("a b " + " ".join(changed) + " c d") == [(0, 1)]
    assert found(" ".join(words).upper().replace(" ", ",  ")) == [(0, 1)]


def test_the_second_passage_may_be_short():
    words = words_of(ITEM)[:26]
    for n in (14, 15, 16, 17):
        assert found(" ".join(words[:n]) + " and then something else entirely in between " + " ".join(words[n + 1 : 21])) == [(0, 1)], n
        assert found(" ".join(words[:n]) + " and then something else entirely in between " + " ".join(words[n + 1 : 20])) == [], n


def test_no_pair_with_enough_words_has_fewer_seeds():
    """Random passages with words changed: every pair that tiling accepts shares the seeds that make it a candidate."""
    r = random.Random(5)
    for _ in range(400):
        n = r.randrange(20, 60)
        item = [f"w{i if r.random() < 0.9 else r.randrange(n)}" for i in range(n)]
        cut = r.randrange(3, n)
        text = [w if r.random() > 0.14 else "zz" for w in item[:cut]] + ["qq"] * 9 + [w if r.random() > 0.14 else "yy" for w in item[cut:]]
        index = Index([(1, " ".join(item))], set())
        ids = np.array([index.vocabulary.get(w, 0) for w in text], np.uint64)
        _, words, own = index.items[0]
        accepted = covered(ids, words, own, index.content[0]) >= leakage.LEAST_WORDS
        assert bool(list(leaks([" ".join(text)], index))) == accepted


def test_a_short_turn_of_phrase_of_the_test_set_adds_nothing():
    words = words_of(ITEM)[:26]
    items = [(1, ITEM), *((n, f"check the {a} find the cause and match {b}") for n, (a, b) in enumerate((("pump", "hose"), ("tank", "seal"), ("gear", "bolt")), 2))]
    turns = leakage.turns_of([t for _, t in items])
    text = " ".join(words[:16]) + " and then something else entirely in between find the cause and match"
    assert [n for *_, n in leaks([text], Index(items, set()))] == [21]
    assert [n for *_, n in leaks([text], Index(items, set(), turns))] == []


def test_wordings_of_many_items_are_looked_at():
    variants = [(n, ITEM.replace("care", x)) for n, x in enumerate(("care", "haste", "skill", "luck"), 1)]
    lone = (9, "quite another opening sentence here. the relay report from venhap loses its daily mailbag whenever tuldul starts to sample a window find the cause and fix it at once.")
    items = [*variants, lone]
    turns = leakage.turns_of([t for _, t in items])
    text = "before it " + " ".join(words_of(ITEM)[:22]) + " after it"
    for chosen in (items, items[2:]):
        assert sorted(i for _, i, _ in leaks([text], Index(chosen, set(), turns))) == sorted(i for i, _ in chosen)


def test_non_leaks():
    words = words_of(ITEM)
    assert found(" ".join(words[:15])) == []
    assert found("Answer in one line. " * 9) == []
    assert found("the gauge report from kelcor loses its wide pump whenever dulsab starts to open a stop find the cause and schedule it") == []
    assert found("", "short") == []


def test_tiles_are_longest_first_and_do_not_overlap():
    r = random.Random(9)
    for _ in range(30):
        doc, item = (np.array([r.randrange(1, 5) for _ in range(r.randrange(3, 30))], np.uint64) for _ in range(2))
        got = tiles(doc, item)
        used_d = [i for a, _, n in got for i in range(a, a + n)]
        used_t = [i for _, b, n in got for i in range(b, b + n)]
        assert len(set(used_d)) == len(used_d) and len(set(used_t)) == len(used_t)
        assert all((doc[a : a + n] == item[b : b + n]).all() and n >= leakage.TILE for a, b, n in got)
        longest = max((n for i in range(len(doc)) for j in range(len(item)) for n in range(1, 31) if i + n <= len(doc) and j + n <= len(item) and (doc[i : i + n] == item[j : j + n]).all()), default=0)
        assert (max(n for *_, n in got) == longest) if longest >= leakage.TILE else not got
    nine = np.arange(1, 10, dtype=np.uint64)
    assert covered(nine, nine, np.array([True] * 8 + [False])) == 8 and covered(nine[:5], nine, np.ones(9, bool)) == 0


def test_leak_frames(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, None, 5), (3, "", 5), (4, "nothing " * 5000 + ITEM, 5), (1, ITEM, 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None)], "item_id long, text string")
    got = find_leaks(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (1, 1), (4, 1)]
    assert [(r.item_id, r.n_documents) for r in leaked_items(got).collect()] == [(1, 3)]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, OTHER)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 1)
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()) == [(1, 1), (2, 2)]


@pytest.mark.skipif(not Path(SF, "documents.parquet").exists(), reason="the driver's tables are not here")
def test_english_by_its_letters(spark):
    docs, levels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/doc_levels.parquet")
    _, model = train(docs, levels)

    def english(text):
        return model.is_english(Counter(prose(text)))

    assert english("We keep the report next to the record it belongs to") and english("The proof relies on the orthogonality of the two monotone operators")
    for text in (
        "Ohne gueltigen Schluessel bricht das Modul nach drei Versuchen ab", "Le module garde le resultat dans un fichier avant la fermeture", "Журнал закрыт и не может быть открыт",
        "Si falta el registro, el proceso se detiene sin tocar la base", "Bu modül sonucu bir dosyada saklar ve sonra işlemi kapatır", "Modulen sparar resultatet i en fil innan den stängs och läses om",
        "Modul uloží výsledek do souboru, než bude spojení uzavřeno",
    ):
        assert not english(text), text
    told = {r.doc_id: r.english for r in reading_levels(docs, levels).collect()}
    graded = {r.doc_id for r in levels.collect()}
    assert sum(told.get(i, True) for i in graded) > 0.99 * len(graded)
    clear = docs.where("lang in ('de', 'fr', 'es') and length(text) > 200").collect()
    assert sum(told[r.doc_id] for r in clear) < 0.1 * len(clear)


def test_levels_on_held_out_documents(spark):
    r = random.Random(8)
    easy, hard = "go run see big red cup door fast good day open file".split(), "monotonicity reconciles asymptotic stratification notwithstanding provenance delineates heterogeneity".split()
    rows = [(i, "the " + " ".join(r.choice(hard if i % 2 else easy) for _ in range(60)), 9) for i in range(80)] + [(200, None, 9), (201, "  ", 9), (202, "der die das und ist nicht " * 5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    levels = spark.createDataFrame([(i, 5 if i % 2 else 1) for i in range(40)] + [(1, None), (2, 99)], "doc_id long, grade int")
    graded = reading_levels(docs, levels)
    assert {x.doc_id for x in demanding(graded).collect()} == {i for i in range(80) if i % 2}
    assert [x.english for x in graded.where("doc_id = 202").collect()] == [False] and graded.where("doc_id in (200, 201)").count() == 0
    assert reading_levels(docs.limit(0), levels).count() == 0
    assert demanding(reading_levels(docs, levels.limit(0))).count() == 0
