"""The numbered operators: defined cases, plain rewrites, exact round trips, held-out labels."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.text import SPACES
from lectern.llm import frequency, lookalike_plans, lookalikes, packing, splitting, stuffing, tokens
from lectern.llm.registry import PLANS
from tests.conftest import SMALL
from tests.oracle import check

DOCUMENTS = "doc_id long, text string, ids string, n int"
T0 = datetime(2025, 1, 1)


def plans() -> dict:
    import importlib

    return {name: (query, module.SQL.get(name)) for module in map(importlib.import_module, PLANS) for name, query in module.QUERIES.items()}


@pytest.mark.parametrize("name", plans())
def test_query(spark, name):
    query, sql = plans()[name]
    if sql is None:
        query(spark, SMALL).collect()
    else:
        check(spark, SMALL, query, sql)


# 1: frequencies


def test_term_frequencies_against_counter(spark):
    random.seed(1)
    terms = [f"t{i}" for i in range(300)]
    records = [(i, random.choice([None, [], random.choices([*terms, "hot", "hot", None], k=random.randint(1, 12))])) for i in range(500)] + [(500, ["hot"] * 2000)]
    counted = [(random.choice([*terms, None, "new"]), f"s{random.randint(0, 9)}", random.randint(0, 9)) for _ in range(200)]
    found = frequency.term_frequencies(
        spark.createDataFrame([(i, t, "clash") for i, t in records], "record_id long, terms array<string>, term string"), spark.createDataFrame(counted, "term string, source_id string, count long")
    )
    uses, notes, added = Counter(), Counter(), Counter()
    for _, own in records:
        uses.update(t for t in own or [] if t is not None)
        notes.update({t for t in own or [] if t is not None})
    for term, _, n in counted:
        added[term] += n
    want = {(t, uses[t], notes[t], added[t]) for t in {*uses, *(t for t, _, _ in counted if t)}}
    assert {tuple(r) for r in found.collect()} == want


def test_frequencies_of_long_records_and_many_blocks(spark):
    long = [f"w{i % 70_000}" for i in range(200_000)]
    rows = [(long,), (["w1", None, "w1"],), ([None],), ([],), (None,)]
    frame = spark.createDataFrame(rows, "terms array<string>").coalesce(1)
    found = {r.term: r for r in frequency.encoded_frequencies(frame).collect()}
    assert len(found) == 70_000 == len({r.id for r in found.values()}) and len({r.id >> 32 for r in found.values()}) == 2
    assert (found["w1"].occurrences, found["w1"].records, found["w69999"].occurrences) == (5, 2, 2)
    batches = [pa.array([["a", "b"], ["a"]]), pa.array([["b", "a", "a"]])]
    whole, parts = frequency.record_block(batches, 1), [frequency.record_block([b], 1) for b in batches]
    summed = lambda found: {tuple(r.values())[1:] for r in frequency._sum_arrays(pa.Table.from_batches(found)).to_pylist()}
    assert summed([whole]) == summed(parts) == {("a", 4, 3, 0), ("b", 2, 2, 0)}


def test_tags_defined_cases(spark):
    notes = spark.createDataFrame(
        [(1, 1, ["old"], T0, None), (1, 2, [" A\\b ", "a/B", None, "  "], T0, None), (1, 2, [" A\\b ", "a/B", None, "  "], T0, None), (2, 1, ["gone"], T0, T0), (3, 1, None, T0, None), (4, None, ["x"], None, None), (None, 1, ["none"], T0, None)],
        "note_id long, version int, tags array<string>, arrived_at timestamp, deleted_at timestamp",
    )
    counts = spark.createDataFrame([("b", "X", 5, T0), ("b", "x ", 7, datetime(2026, 1, 1)), ("c", "x", -3, T0), ("c", "y", None, T0), ("c", " ", 3, T0), ("c", None, 3, T0)], "batch string, tag string, count long, counted_at timestamp")
    got = {r.tag: (r.occurrences, r.here, r.archived, r.mark) for r in frequency.tag_frequencies(notes, counts).collect()}
    assert got == {"a/b": (2, 1, 0, "rare"), "x": (1, 1, 7, "common"), "y": (0, 0, 0, None)}
    empty = frequency.tag_frequencies(notes.limit(0), counts.limit(0))
    assert empty.count() == 0


# 3: look-alikes


def test_canonical_keeps_what_differs(spark):
    groups = [
        ["the café", "the café", "thе café", "ｔhe café", "t​he　ca­fé", "𝗍𝗁𝖾 café"],
        ["The café"], ["the cafe"], ["the  café"], ["the cafés"], ["x2"], ["x²"], ["ﬁne K", "fine K"], ["1l"], ["ll"], ["O0"], ["OO", "ОΟ"], ["“a”"], ['"a"'], ["a—b"], ["a-b"], ["no", "​no"], ["список"], ["σημείωση"],
    ]
    rows = [(i, t) for i, t in enumerate(t for g in groups for t in g)]
    got = {r.content_id: r.canonical for r in lookalikes.canonical_contents(spark.createDataFrame([(i, t, "x") for i, t in [*rows, (99, None), (98, ""), (97, "​")]], "content_id long, content string, canonical string")).collect()}
    ids = iter(range(len(rows)))
    looks = [{got[next(ids)] for _ in g} for g in groups]
    assert all(len(look) == 1 for look in looks) and len(set().union(*looks)) == len(groups)
    assert got[99] is None and got[98] == "" and got[97] == ""


def test_pairs_against_all_pairs(spark):
    random.seed(3)
    plain = ["alpha note", "beta note", "Gamma", "d"]
    alike = {"a": "aаａ𝖺", "o": "oоο", "e": "eе", "t": "tｔ", " ": "  　", "d": "dԁ"}
    rows = [(i, "".join(random.choice(alike.get(c, c)) + random.choice(["", "", "‍"]) for c in random.choice(plain))) for i in range(120)]
    rows += rows[:20] + [(1000, None), (1001, "")]
    texts = dict(rows)
    key = lambda t: "".join(next((k for k, v in alike.items() if c in v), c) for c in t.replace("‍", ""))
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] and texts[b] and texts[a] != texts[b] and key(texts[a]) == key(texts[b])}
    frame = spark.createDataFrame([(i, t, "q") for i, t in rows], "content_id long, content string, spelt string")
    found = lookalikes.look_alike_pairs(lookalikes.canonical_contents(frame)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


ENGLISH = "open source paper house corner garden people season escape carpet oxygen hope space topic episode sample process access expose compose person prose copy ocean pepper soap rope axe ace cope".split()
RUSSIAN = "сосна осень море просто хорошо ворота дорога работа опора норма сахар река народ рост город корова образ ответ вопрос порог отец смех успех роса оса перо поход порт спор совесть".split()
GREEK = "πρόγραμμα όνομα κόσμος τόπος νόμος χώρα δρόμος ουρανός χρόνος λόγος γράμμα πόλη θάλασσα βουνό άνθρωπος όρος νερό φως ήλιος καιρός".split()


def test_reading_gives_swapped_letters_their_script_back(spark):
    """Words with half of their look-alikes swapped come out in their true script; the Latin skeleton alone would fail all but the Latin ones."""
    random.seed(33)
    classes = lookalikes.Symbols(lookalikes.LOOK_ALIKES).readings
    swap = lambda w: "".join(random.choice(classes[c]) if c in classes and random.random() < 0.5 else c for c in w)
    lines = [" ".join(random.choices(own, k=12)) for own in (ENGLISH, RUSSIAN, GREEK) for _ in range(60)]
    swapped = [(w, swap(unicodedata.normalize("NFD", w))) for own in (ENGLISH, RUSSIAN, GREEK) for w in own for _ in range(4)]
    rows = [*enumerate(lines), *((1000 + i, s) for i, (_, s) in enumerate(swapped))]
    got = {r.content_id: r.canonical for r in lookalikes.canonical_contents(spark.createDataFrame(rows, "content_id long, content string")).collect()}
    right = [got[1000 + i] == unicodedata.normalize("NFC", w) for i, (w, _) in enumerate(swapped)]
    skeleton = [w == "".join(lookalikes.LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", w)) for w, _ in swapped]
    assert sum(right) > 0.95 * len(right) and sum(skeleton) < 0.5 * len(right)


def test_long_words_are_read_whole():
    symbols = lookalikes.Symbols(lookalikes.LOOK_ALIKES)
    reader = lookalikes.Reader(symbols, lookalikes.pair_costs(lookalikes.pair_counts(["место порт спор"] * 9, symbols), symbols))
    assert reader.canonical("cпоp" * 5000) == "спор" * 5000


def test_classes_name_all_spellings(spark):
    rows = [(i, t) for i, t in enumerate(["note", "nоte", "nоte", "other", "ｎote", None, ""])]
    canonical = lookalikes.canonical_contents(spark.createDataFrame(rows + rows, "content_id long, content string"))
    found = lookalikes.look_alike_classes(canonical).collect()
    assert {(r["class"], r.contents) for r in found} == {(0, 1), (0, 2)} and len(found) == 3 and len({r.look for r in found}) == 1
    pairs = lambda group: {tuple(r) for r in lookalikes.look_alike_pairs(canonical, group).collect()}
    assert pairs(1) == pairs(100) == {(0, 1), (0, 2), (0, 4), (1, 4), (2, 4)}


def test_list_of_look_alikes_is_tidied(spark):
    rows = [("а", "a"), ("а", "ａ"), ("х", None), ("—", " - "), ("é", "é"), (" ", " "), (None, "x"), ("U+3000", " "), ("ꬰ", "a"), ("ꬰ", "b"), ("ꬰ", "b")]
    assert lookalikes.defined_look_alikes(spark.createDataFrame(rows, "char string, replacement string")) == {"а": "a", "ꬰ": "b"}


def test_canonical_on_the_notes(spark):
    rows = [r for r in lookalike_plans.p3_canonical(spark, SMALL).collect() if r.canonical]
    assert rows and all(unicodedata.is_normalized("NFC", r.canonical) and not any(unicodedata.category(c) == "Cf" for c in r.canonical) for r in rows)


# 4: splitting


def measure(text: str) -> int:
    lines = text.split("\n")
    fences, rows = sum(x.startswith("```") for x in lines), sum(x.strip(SPACES)[:1] == "|" == x.strip(SPACES)[-1:] for x in lines)
    return math.ceil(len(text.encode("utf-16-le")) / 8) + math.ceil(2 * fences + rows / 2)


def check_cut(texts: list[str], limit: int, overlap: int) -> None:
    pieces = defaultdict(list)
    for text, piece, begin, end, _ in splitting.cut(texts, limit, overlap):
        pieces[text].append((piece, begin, end))
    for i, text in enumerate(texts):
        own = pieces[i]
        assert [p for p, _, _ in own] == list(range(len(own))) and own[0][1] == 0 and own[-1][2] == len(text)
        assert all(measure(text[b:e]) <= limit for _, b, e in own)
        for (_, b, e), (_, b2, e2) in itertools.pairwise(own):
            assert b < b2 <= e < e2 and measure(text[b2:e]) <= overlap


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab |`\n.#\U0001f600。́", min_size=1, max_size=3000), min_size=1, max_size=4))
def test_cut_covers_within_limits(texts):
    check_cut(texts, 96, 12)


def test_cut_extremes_and_natural_places():
    check_cut(["a" * 20_000, "|\n" * 9_000, "```\n" * 5_000, " " * 20_000, "\n" * 20_000, "́" * 9_000, "\U0001f600" * 9_000, "日本語。" * 5_000, "word " * 9_000], 512, 64)
    text = "# One\n\n" + "A sentence here. " * 90 + "\n\n# Two\n\n" + "Other words go on. " * 90
    first = next(splitting.cut([text]))
    assert text[first[3] :].startswith("# Two") and splitting.KINDS[first[4]] == "heading"


def test_unbroken_runs_overlap():
    for text in ("a" * 20_000, "\U0001f600" * 9_000, "words before " * 30 + "b" * 9_000 + " words after" * 30, "é" * 9_000):
        check_cut([text], 512, 64)
        cuts = list(splitting.cut([text], 512, 64))
        repeated = [measure(text[b[2] : a[3]]) for a, b in itertools.pairwise(cuts) if splitting.KINDS[a[4]] == "character"]
        assert repeated and min(repeated) >= 60


def test_split_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 1000), (4, "word " * 1000), (None, "x " * 5000)]
    got = splitting.split_texts(spark.createDataFrame([(k, t, 1) for k, t in rows], "key long, content string, piece int")).collect()
    assert {r.key for r in got} == {4} and max(r.tokens for r in got) <= 512 and len(got) == len({r.piece for r in got})
    sections = spark.createDataFrame([(1, "word " * 1000, "h"), (2, "tiny", "h")], "section_id long, content string, heading string")
    items = [(1, 600, 1), (2, None, 1), (3, -1, 2), (4, 513, 2), (5, 513, None), (6, 512, 1), (7, 0, 1), (7, 0, 1), (8, 1400, 99)]
    found = splitting.split_vault(sections, spark.createDataFrame([(i, t, s, "k") for i, t, s in items], "item_id long, tokens int, section_id long, kind string")).collect()
    by = Counter((r.table_name, r.item_id) for r in found)
    assert {k: n for k, n in by.items() if k[1] != 1 or k[0] == "context_item"}.keys() == {("context_item", i) for i in (1, 2, 4, 5, 7, 8)}
    assert by["context_item", 1] == by["section_slice", 1] == by["context_item", 7] and by["context_item", 8] == 3
    assert splitting.split_vault(sections.limit(0), spark.createDataFrame([], "item_id long, tokens int, section_id long")).count() == 0


# 5: encoding


def reference_encoder():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]


ODD = ["", "'", "'s", " 's", "''s", "\n's", "don't we'll've I'D", " \n x", "x \n", "  x", "\0\0", "<|endoftext|>", "a" * 3000, "ab " * 2000, "　x\x85\x1c y", "½Ⅷ²１", "日本語ー。​", "\U0001f600" * 50]


def test_encode_is_exact(spark):
    random.seed(5)
    alphabet = " '\n\t\rsdmtlveré²½１日。!?-_0　\xa0\U0001f600"
    texts = ODD + ["".join(random.choices(alphabet, k=random.randint(1, 40))) for _ in range(3000)]
    got = {r.doc_id: r.ids for r in tokens.encode(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCUMENTS)).collect()}
    assert [got[i] for i in range(len(texts))] == reference_encoder()(texts)


def test_encode_documents_and_defined_cases(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in tokens.encode(documents).collect()}
    assert [got[r.doc_id] for r in rows] == reference_encoder()([r.text or "" for r in rows])
    odd = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "a", None, None)], DOCUMENTS)
    assert sorted((r.doc_id or 0, r.ids) for r in tokens.encode(odd).collect()) == [(0, [64]), (1, []), (1, [])]
    assert tokens.encode(odd.limit(0)).count() == 0
    assert {(r.doc_id, r.tokens) for r in tokens.encode(odd, count_only=True).collect()} == {(1, 0), (None, 1)}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_last_tokens_give_the_merges_result(data):
    assert ENCODER.encode(data) == ENCODER.merged(data)


ENCODER = tokens.Encoder(tokens.read_vocabulary())


# 6: containers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_first_fit_against_scan(sizes):
    sizes.sort(reverse=True)
    room, want = [], []
    for size in sizes:
        at = next((i for i, r in enumerate(room) if r >= size), len(room))
        room += [50] * (at == len(room))
        room[at] -= size
        want.append(at)
    assert packing.first_fit(sizes, 50) == want


def test_containers_hold_everything(spark):
    random.seed(6)
    rows = [(i, random.choice([None, 0, -3, 4096 + random.randint(1, 900), random.randint(1, 900)]), "x") for i in range(3000)] + [(7, 10, "x"), (None, 9, "x")]
    filled = packing.fill_containers(spark.createDataFrame(rows, "key long, size long, container string"), 2048, group_items=500)
    got = filled.collect()
    used, pieces = Counter(), defaultdict(list)
    for r in got:
        used[r.container] += r.size
        pieces[r.key].append(r)
    want = Counter()
    for k, s, _ in rows:
        want[k] += max(s or 0, 0)
    assert max(used.values()) <= 2048 and {k: sum(r.size for r in v) for k, v in pieces.items()} == {k: s for k, s in want.items() if s}
    assert all(len(v) == (1 if want[k] <= 2048 else math.ceil(want[k] / 2048)) for k, v in pieces.items() if k not in (7, None))
    assert sum(used.values()) / (2048 * len(used)) > 0.97
    assert packing.fill_containers(filled.limit(0).select("key", "size"), 2048).count() == 0
    (report,) = packing.fill_report(filled, 2048).collect()
    assert (report.containers, report.pieces, report.fullest) == (len(used), len(got), max(used.values()))


# 7: stuffing

PROSE = "The owner of the page moved {} notes after lunch. Nobody asked why the archive stayed open.\nWe compared the old list with the new one, because {} was missing."


def test_stuffed_pages_among_honest_ones(spark):
    random.seed(7)
    names = [f"{a}{b}{c}" for a in ("bra", "flo", "kri", "spe") for b in ("ndo", "lke", "rti") for c in ("m", "sk", "va")]
    honest = [(i, "\n\n".join(PROSE.format(random.choice(names), random.choice(names)) for _ in range(random.randint(1, 5)))) for i in range(300)]
    cheap = ["cheap", "best", "buy", "online", "free"]
    lists = [", ".join(f"{random.choice(cheap)} {random.choice(own)} bag" for _ in range(60)) for own in [random.sample(names, 3) for _ in range(10)]]
    links = ["\n".join(f"- https://shop{i}.example/{random.choice(cheap)}-{own}-bag" for i in range(40)) for own in names[:5]]
    tags = [" ".join(f"#{random.choice(cheap)}_{random.choice(own)}" for _ in range(50)) for own in [random.sample(names, 2) for _ in range(5)]]
    chant = [f"Looking for a {n} bag? Our {n} bag is the best {n} bag for every {n} bag fan. " * 8 for n in names[:5]]
    wide = ["".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t) for t in lists[:3]]
    stuffed = [(1000 + i, t) for i, t in enumerate(lists + links + tags + chant + wide + lists[:2])]
    logs = [(2000, "\n".join(f"2025-01-{i % 28 + 1:02}T10:00:00Z INFO {random.choice(names)}: moved {random.choice(names)} after {i} ms" for i in range(80)))]
    code = [(2001, "```sql\n" + "\n".join(f"select {n}_id, count(*) from {n} group by {n}_id;" for n in names) + "\n```")]
    table = [(2002, "| item | owner | count |\n|---|---|---|\n" + "\n".join(f"| {n} | {m} | {i} |" for i, (n, m) in enumerate(zip(names, names[::-1]))))]
    half = [(2003, honest[0][1] * 3 + "\n\n" + lists[0][:200])]
    rows = honest + stuffed + logs + code + table + half + [(3000, None), (3001, ""), (3002, " \n ")]
    got = {r.doc_id: r.share for r in stuffing.stuffed_shares(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCUMENTS)).collect()}
    assert {i for i, s in got.items() if s > 0.5} == {i for i, _ in stuffed}
    assert got[3000] == got[3001] == got[3002] == 0 and len(got) == len(rows)
    assert stuffing.stuffed_pages(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_stuffed_pages_agree_with_readers(spark):
    directory = "/root/testdata/sf0.01"
    found = {r.doc_id for r in stuffing.stuffed_pages(spark.read.parquet(f"{directory}/documents.parquet")).collect()}
    votes = spark.read.parquet(f"{directory}/doc_label.parquet").groupBy("doc_id").agg(F.sum(F.when(F.lower(F.trim("label")) == "spam", 1).when(F.lower(F.trim("label")) == "ok", -1).otherwise(0)).alias("n")).filter("n <> 0").collect()
    assert sum((r.n > 0) == (r.doc_id in found) for r in votes) >= 0.95 * len(votes)


def test_only_information_tells_lists_from_salad(spark):
    """Lists without a full stop in one layout: runs of phrases that the collection uses, and the same words strung together."""
    random.seed(9)
    phrases = [w.split() for w in ("close the door", "water the plants", "send the weekly report", "call the night desk", "renew the site permit", "order more paper", "check the boiler room", "move old files away", "read the survey notes", "clean the coffee machine")]
    honest = [(i, "\n".join("- " + " ".join(p) for p in random.sample(phrases, 8))) for i in range(200)]
    words = sorted({w for p in phrases for w in p if w != "the"})
    salad = []
    for i in range(10):
        own = random.sample(words, len(words))
        salad.append((1000 + i, "\n".join("- " + " ".join(own[j : j + 3]) for j in range(0, len(own) - 2, 3))))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in honest + salad], DOCUMENTS)
    assert {r.doc_id for r in stuffing.stuffed_pages(frame).collect()} == {i for i, _ in salad}


def test_frequent_and_joined_pairs_give_one_result(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    few, many = ({(r.doc_id, round(r.share, 9)) for r in stuffing.stuffed_shares(documents, None, n).collect()} for n in (0, 1 << 16))
    assert few == many and any(s > 0.5 for _, s in many)


def test_copies_are_counted_once(spark):
    random.seed(10)
    salad = " ".join(random.sample(["".join(x) for x in itertools.product("bdfg", "aeiou", "klmn", "ou")], 120))
    honest = [(i, PROSE.format(f"n{i}", f"m{i}")) for i in range(60)]
    rows = honest + [(1000 + i, salad) for i in range(400)]
    assert {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCUMENTS)).collect()} == {i for i, t in rows if t == salad}


def test_rare_words_count_as_themselves(spark):
    random.seed(8)
    made = ["".join(x) for x in itertools.product(("ba", "do", "fe", "gi", "ku", "la", "mo"), repeat=4)]
    random.shuffle(made)
    common, phrases = made[:2200], [made[i : i + 6] for i in range(2200, 2398, 6)]
    pages = [" ".join(common[i : i + 40]) + f"\n{k}" for i in range(0, 2200, 40) for k in range(12)]  # the number makes it no copy
    pages += [" ".join(sum(phrases[i : i + 3], [])) + f"\n{k}" for i in range(0, 33, 3) for k in range(4)]
    loose = sum(phrases[:3], [])
    random.shuffle(loose)
    rows = list(enumerate(pages)) + [(9001, " ".join(sum(phrases[:3], []))), (9002, " ".join(loose))]
    got = {r.doc_id: r.share for r in stuffing.stuffed_shares(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCUMENTS)).collect()}
    assert got[9001] == 0 and got[9002] == 1
    found = stuffing.stuffed_pages(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCUMENTS)).collect()
    assert {r.doc_id for r in found} == {i for i, s in got.items() if s > 0.5}
