"""Near duplicates, decontamination and fingerprints against brute force."""

import hashlib
import math
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from novelspark.llm import components, decontaminate, fingerprint, neardup, textvec

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash") for i, t in rows], DOCS)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randint(20, 120))]
        text = " ".join(words)
        rows.append(text)
        if i % 3 == 0:  # near copies, a chain of them
            for _ in range(3):
                words = list(words)
                words[rng.randrange(len(words))] = word()
                rows.append(" ".join(words))
        if i % 4 == 0:
            rows.append(text.upper() + "  \n")
        if i % 2 == 0:
            rows.append(text[:60] + " " + passage)
    rows += ["", None, "   ", "one", "One", "two words", "two  words", "a b c d", "x" * 50_000, "é è"]
    return [(i * 3 % 1000 + i // 1000, t) for i, t in enumerate(rows)]


def brute_sets(rows, ngram):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + ngram]) for i in range(max(1, len(w) - ngram + 1))) if w else frozenset())
    return sets


def brute_links(rows, ngram=4, percent=85):
    """Overlaps of linked different sets."""
    sets = sorted(set(brute_sets(rows, ngram)), key=sorted)
    found = {}
    for i, x in enumerate(sets):
        for y in sets[:i]:
            n = len(x & y)
            if n and 100 * n >= percent * len(x | y):
                found[frozenset([x, y])] = n
    return found


def brute_components(rows, ngram=4, percent=85):
    """n_shingles, component_id, class_id, n_links of each row."""
    sets, pairs = brute_sets(rows, ngram), brute_links(rows, ngram, percent)
    label = {s: s for s in sets}

    def find(s):
        while label[s] is not s:
            s = label[s]
        return s

    for x, y in map(tuple, pairs):
        label[find(x)] = find(y)
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    ids, own = {}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        ids.setdefault(find(s), []).append(d)
        own.setdefault(s, []).append(d)
    degree = {s: sum(s in p for p in pairs) for s in set(sets)}
    return [(len(s), least(ids[find(s)]), least(own[s]), degree[s]) if s else (0, d, d, 0) for (d, _), s in zip(rows, sets, strict=True)]


COLUMNS = ("doc_id", "n_shingles", "component_id", "class_id", "n_links")


@pytest.mark.parametrize(("ngram", "percent", "rows_a_block", "dense"), [(4, 85, neardup.BLOCK_ROWS, neardup.DENSE), (4, 85, 2, 0), (5, 80, 3, 10**9)])
def test_near_duplicates(spark, monkeypatch, ngram, percent, rows_a_block, dense):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_a_block)  # homes of many tiles
    monkeypatch.setattr(neardup, "DENSE", dense)
    rows = corpus()
    rows.append(rows[0])
    got = neardup.near_duplicates(frame(spark, rows), ngram, percent).collect()
    want = brute_components(rows, ngram, percent)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))
    kept = [r.doc_id for r in neardup.keep_first(frame(spark, rows), ngram, percent).collect()]
    assert sorted(kept) == sorted({w[1] for w in want if w[0]} | {d for (d, _), w in zip(rows, want, strict=True) if not w[0]})


def test_links_between_classes(spark):
    rows = corpus()
    got = neardup.links(frame(spark, rows), 4, 85).collect()
    assert sorted(r.overlap for r in got) == sorted(brute_links(rows).values())
    assert len({(r.a, r.b) for r in got}) == len(got) and all(r.a < r.b for r in got)


def test_one_ngram_in_thousands(spark):
    """A passage that all documents share, and a large group of near copies of one text."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join(word() for _ in range(rng.randint(6, 14))) + " " + passage) for i in range(5000)]
    base = [word() for _ in range(150)]
    for i in range(400):
        words = list(base)
        words[rng.randrange(150)] = word()
        rows.append((5000 + i, " ".join(words)))
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows), 4, 85).collect()}
    assert all(got[i].component_id == i and got[i].n_links == 0 for i in range(5000))
    assert {got[i].component_id for i in range(5000, 5400)} == {5000}
    near = [(5000 + i, t) for i, (_, t) in enumerate(rows[5000:])]
    for (d, _), w in list(zip(near, brute_components(near), strict=True)):
        assert (got[d].n_shingles, got[d].component_id, got[d].class_id, got[d].n_links) == w


def test_near_duplicates_nulls_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, None), (7, "a b c d e")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (1, 7), (1, 7), (1, 7), (1, 7)]
    assert sorted((r.doc_id is None, r.text) for r in neardup.keep_first(frame(spark, rows)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(False, "a b c d e"), (True, "")]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.keep_first(frame(spark, [])).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    draw = lambda k: [np.sort(rng.choice(pool, rng.integers(0, 40), replace=False)) for _ in range(k)]
    for dense, pairs in ((0, 4_000_000), (10**9, 7), (150, 50)):
        monkeypatch.setattr(neardup, "DENSE", dense)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        monkeypatch.setattr(neardup, "WIDE", 5)
        x, y = draw(9), draw(6)
        want = lambda p, q: [[len(np.intersect1d(s, t)) for t in q] for s in p]
        assert neardup.overlaps(x, y).tolist() == want(x, y)
        own = neardup.overlaps(x)
        assert all(own[i, j] == want(x, x)[i][j] for i in range(9) for j in range(9) if i != j)


def test_keep_first_whatever_the_columns(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "x y"), (3, None)]
    names = ["_id", "_hash", "_text_hash", "group", "class", "stays", "n"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    got = neardup.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, *(r[c] for c in names)) for r in got.collect()) == [(i, *names) for i in (0, 1, 3)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


ITEM = "In 1999 the river Thames rose by 12 km over the old stone bridge near Oxford, said Mary Jones to the paper."


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, "the quick brown fox jumps over the lazy dog while it rains today")], "item_id bigint, text string")
    other = ITEM.replace("1999", "2024").replace("12", "7").replace("Mary", "Anna")
    bent = ITEM + " " + "filler " * 9
    rows = [(1, "Before. " + ITEM + " after"), (2, "so. " + other), (3, "a clean text about the river that rose over the bridge"), (4, None), (5, ""), (6, bent), (7, ITEM[:40]), (None, "x " + ITEM), (1, "another row of the same id")]
    found = {(r.doc_id, r.item_id): r.exact for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert found == {(1, 1): True, (2, 1): False, (6, 1): True, (None, 1): True}
    left = decontaminate.clean(frame(spark, rows), bench)
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(1, rows[8][1]), (3, rows[2][1]), (4, ""), (5, ""), (7, rows[6][1])])
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    assert decontaminate.clean(frame(spark, rows), bench.where("false")).count() == len(rows)


def test_inconsistent_slots_do_not_count(spark):
    item = "Add 5 apples and 5 pears and then take 5 plums from the big brown basket on the table"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    # all changed alike; one changed, so that half of the windows still stand; changed unlike
    rows = [(1, item.replace("5", "8")), (2, item.replace("5", "8", 1)), (3, item.replace("5", "8").replace("8 plums", "9 plums"))]
    found = {r.doc_id: r.exact for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert found == {1: False, 2: True}


NUMBERS = {"three", "seven", "twelve", "forty"}


def canonical_words(text):
    """(canonical word, the same if a capital at a sentence's start is a name, word as it
    stands) of an ASCII text, word by word."""
    out, last, end = [], "", 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        fresh = not last or last[-1] in ".!?:;" or "\n" in text[end : m.start()]
        last, end = m[0], m.end()
        w = m[0].strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
        if not w:
            continue
        number = all(c in "0123456789.,:/%-+" for c in w) and any(c.isdigit() for c in w) or w.lower() in NUMBERS
        name = False
        if number:
            kind = "<number>"
        elif w[0].isdigit():
            kind = "<joined>"
        elif out and out[-1][0] == "<number>" and w.lower() in ("km", "kg", "m", "hours", "dollars", "miles"):
            kind = "<unit>"
        else:
            kind = w.lower()
            name = w[0].isupper() and (sum(c.isupper() for c in w) <= 1 or len(w) <= 5)
        out.append(("<name>" if name and not fresh else kind, "<name>" if name else kind, w.lower()))
    return out


def brute_matches(docs, bench):
    out = set()
    for d, text in docs:
        have = canonical_words(text)
        for item_id, item in bench:
            want = canonical_words(item)
            width = min(8, len(want))
            if not want or width < 4 and len(have) != width:
                continue
            diagonals = {}
            for p in range(len(want) - width + 1):
                for q in range(len(have) - width + 1):
                    x, y = want[p : p + width], have[q : q + width]
                    raw = [w[2] for w in x] == [w[2] for w in y]
                    slots = plain = None
                    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                        of = [w[a] for w in x]
                        words = sum(k[0] != "<" for k in of)
                        if slots is None and of == [w[b] for w in y] and words >= (1 if width == 8 else min(2, width)) and (width >= 5 or len(have) == width):
                            slots, plain = [(v[2], w[2]) for k, v, w in zip(of, x, y, strict=True) if k[0] == "<"], words
                    if raw or slots is not None:
                        diagonals.setdefault(q - p, {})[p] = (raw, slots or [], raw or plain >= min(3, width))
            counted, most = {}, 0
            for places in diagonals.values():
                runs = []
                for p in sorted(places):
                    if runs and runs[-1][-1] == p - 1:
                        runs[-1].append(p)
                    else:
                        runs.append([p])
                for run in runs:
                    values = {}
                    for p in run:
                        for v, w in places[p][1]:
                            values.setdefault(v, set()).add(w)
                    bent = any(len(w) > 1 for w in values.values())
                    bent |= not (any(places[p][2] for p in run) or len(run) == len(want) - width + 1)
                    streak = 0
                    for p in run:
                        streak = streak + 1 if places[p][0] else 0
                        most = max(most, streak + width - 1 if streak else 0)
                        if places[p][0] or not bent:
                            counted[p] = counted.get(p, True) and places[p][0]
            share = len(counted) / (len(want) - width + 1)
            if share >= 0.5 or most >= 20:
                out.add((d, item_id, round(share, 6), all(counted.values()), most))
    return out


def replaced(rng, text):
    """An item with other numbers, names and units, each alike throughout."""
    names, units = ["Otto", "Lena", "Yusuf", "Ingrid"], ["miles", "hours", "dollars", "kg"]
    swap = {}
    out = []
    for w in text.split(" "):
        bare = w.strip(".,?")
        if bare not in swap:
            if bare.isdigit() or bare in NUMBERS:
                swap[bare] = rng.choice([str(rng.randint(2, 990)), "seven", "forty"])
            elif bare in ("Mary", "Tom", "Paris"):
                swap[bare] = names[len(swap) % 4]
            elif bare in ("km", "kg", "hours", "dollars"):
                swap[bare] = rng.choice(units)
            else:
                swap[bare] = bare
        out.append(w.replace(bare, swap[bare]) if bare else w)
    return " ".join(out)


QUESTIONS = [
    "What is 3 + 5 * 7 - 2",
    "Mary has 5 apples and buys 3 more",
    "Tom walks 12 km and then 4 km back to the house where Mary waits for 3 hours.",
    "Mary and Tom share 40 dollars so that Mary gets 3 times as much as Tom. How much does Tom get?",
    "A train from Paris needs three hours for 300 km, how many hours for 900 km?",
    "If seven boxes hold 12 kg of salt each, what do 30 boxes weigh?",
    "Compute 12 * 4 + 9 and then divide it by 3",
    "Tom sold twelve books for 5 dollars and 9 books for 7 dollars. Mary sold 20 for 3 dollars.",
]


def test_recall_of_reparameterised_questions(spark):
    """Other numbers (digits or words), names and units; at a text's start, in a sentence, after a stop."""
    rng = random.Random(11)
    bench = spark.createDataFrame(list(enumerate(QUESTIONS)), "item_id bigint, text string")
    rows, planted = [], {}
    for item, text in enumerate(QUESTIONS):
        for _ in range(10):
            new = replaced(rng, text)
            for before in ("", "we know that ", "Something else. ", "So "):
                planted[len(rows)] = item
                rows.append((len(rows), before + new + rng.choice([" today", "", ". And so on, as they say."])))
    clean = ["Mary has many apples in her house and buys no more of them", "What is there to see in the 5 old towns by the river", "the price was 12 dollars, 4 dollars, 9 dollars and 30 dollars", "5 12 7 9 3 8 40 300 12", "Tom walks to the house where the train from Paris waits"]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    hits = sum((d, item) in found for d, item in planted.items())
    assert hits / len(planted) >= 0.9, hits / len(planted)
    assert not {d for d, _ in found} & {1000 + i for i in range(len(clean))}
    assert all(planted[d] == item for d, item in found)


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "capital of France is"), (2, "so it goes"), (3, "three apples for Tom fell down"), (4, "1 2 3 4 5 6")], "item_id bigint, text string")
    rows = [(1, "The capital of France is Paris"), (2, "and so it goes on"), (3, "so it goes"), (4, "We saw that four apples for Otto fell down there"), (5, "the capital of Spain is"), (6, "9 1 2 3 4 5 6 7"), (7, "7 8 9 10 11 12")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, rows), bench).collect()} == {(1, 1), (3, 2), (4, 3), (6, 4)}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["the", "river", "bridge", "over", "Anna", "Berlin", "12", "7", "3.5", "km", "kg", "5kg", "rose", "a", "in", "(and)", "then.", "Then", "--", "to", "seven", "Anna", "hours"]
    words = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [words(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 45, 100)] + [["5", "7", "12"] * 4]
    docs = []
    for item in items * 6:
        text = list(item)
        if rng.random() < 0.6:
            swap = {w: rng.choice(["12", "7", "99"]) for w in ("12", "7", "3.5")} | {"Anna": "Otto"}
            text = [swap.get(w, w) if rng.random() < 0.9 else w for w in text]
        start = rng.randrange(len(text)) if rng.random() < 0.3 else 0
        text = text[start:]
        docs.append((text if rng.random() < 0.2 else words(rng.randrange(15)) + text + words(rng.randrange(15))))
    docs = [(i, rng.choice([" ", "  ", " \n"]).join(t)) for i, t in enumerate(docs)]
    docs += [(900 + i, " ".join(words(60))) for i in range(30)] + [(990, "x" * 70 + "." * 200 + " " + " ".join(items[9])), (991, None), (992, "." * 300)]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, round(r.covered, 6), r.exact, r.exact_words) for r in decontaminate.matches(frame(spark, docs), table).collect()}
    assert got == brute_matches(docs, bench) and len(got) > 20


def test_clean_whatever_the_columns(spark):
    docs = spark.createDataFrame([(1, "so " + ITEM, "x", "y", 1), (2, "fine", "x", "y", 2)], "doc_id bigint, text string, _id string, _hash string, item bigint")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "fine", "x", "y", 2)]


def test_fingerprints(spark):
    rows = [(3, "b c d e f g h"), (1, "a b"), (2, None), (5, ""), (5, " "), (9, "a b"), (None, "n n n")]
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in order]
    want = {}
    for i, (d, t) in enumerate(order):
        h = len(t) // 2
        edited = t[: len(t) - h] + texts[(i + 1) % len(texts)][:h]
        want.setdefault(d, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    by = {r.doc_id: r for r in got if r.doc_id not in (5,)}
    assert by[1].fingerprint == by[9].fingerprint != by[3].fingerprint
    assert by[2].fingerprint == "0" * 8 * fingerprint.SAMPLES and by[2].near_edited == 1.0 and by[2].near_next == 0.0
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


def test_plan_holds_few_samples(spark, monkeypatch):
    calls, draws = [], fingerprint.draws
    monkeypatch.setattr(fingerprint, "draws", lambda *a: calls.append(a) or draws(*a))
    fingerprint.fingerprints(frame(spark, [(1, "a b"), (2, "b c")]))
    assert 0 < len(calls) <= fingerprint.SAMPLES // 4  # the driver keeps and plans these


def brute_signature(text):
    """The samples of a text by the definition: (term, t) of least ln a, by its hash."""
    from collections import Counter

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    least = [math.inf] * fingerprint.SAMPLES
    for word, w in Counter(re.findall(r"[^ \t\n\x0B\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))).items():
        term = xxhash.xxh64_intdigest(word.encode(), 42)
        for k in range(fingerprint.SAMPLES):
            h = xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", signed(term)), 42))
            u = lambda shift, bits: (((h >> shift) & ((1 << bits) - 1)) + 0.5) / (1 << bits)  # noqa: E731, B023
            r, ln_c, b = -math.log(u(0, 10) * u(10, 10)), math.log(-math.log(u(20, 16) * u(36, 16))), u(52, 12)
            least[k] = min(least[k], ln_c - r * (math.floor(math.log(w) / r + b) - b + 1))
    return least if least[0] < math.inf else None


def test_signatures_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"W{i}É" for i in range(12)] + ["The", "the", "É", "é", "x" * 300]
    rows = [(i, rng.choice([" ", "\t\n"]).join(rng.choices(words, k=rng.randrange(40)))) for i in range(60)]
    rows += [(60, None), (61, rows[3][1]), (62, rows[3][1].swapcase()), (63, " ".join(words * 2000))]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    want = [brute_signature(t) for _, t in rows]
    same = lambda x, y: 1.0 if x is None and y is None else 0.0 if x is None or y is None else sum(abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True)) / fingerprint.SAMPLES
    for i, (_, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert got[i].near_next == same(want[i], want[(i + 1) % len(rows)])
        assert got[i].near_edited == same(want[i], brute_signature(t[: len(t) - half] + after[:half]))
        for j in range(0, len(rows), 7):  # equal samples have equal places in the fingerprints
            x, y = got[i].fingerprint, got[j].fingerprint
            if want[i] and want[j]:
                assert sum(x[8 * k : 8 * k + 8] == y[8 * k : 8 * k + 8] for k in range(fingerprint.SAMPLES)) == fingerprint.SAMPLES * same(want[i], want[j])
    assert got[3].fingerprint == got[61].fingerprint


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "NEAR", 2)
    ids = [i * i * 7 for i in range(200)] + [10**12, None, None]
    rows = [(d, f"t{i}") for i, d in enumerate(ids)]
    out = fingerprint.with_next(frame(spark, rows), rows=5).where("not head").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {(d, t): order[(i + 1) % len(order)][1] for i, (d, t) in enumerate(order)}
    assert {(r.doc_id, r.text): r.next for r in out} == want


def test_collision_rate_is_weighted_jaccard(spark):
    a, b = "x " * 5 + "y " * 3 + "z w v u", "x " * 3 + "y " * 4 + "z w q r"
    docs = [(i, " ".join(f"{w}{i // 2}" for w in (a if i % 2 == 0 else b).split())) for i in range(200)]
    near = [r.near_next for r in fingerprint.fingerprints(frame(spark, docs)).where("doc_id % 2 = 0").collect()]
    assert abs(np.mean(near) - (3 + 3 + 1 + 1) / (5 + 4 + 1 + 1 + 1 + 1 + 1 + 1)) < 0.03


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a  b\x0bcd", None, "", "é\tz ", "q"]
    (docs,) = textvec.steps(pa.array(texts))
    w = textvec.words(docs)
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 1]
    assert [docs.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["a", "b", "cd", "é", "z", "q"]
    assert (textvec.Hasher(docs.data)(w.start, w.end) == textvec.hash_words(["a", "b", "cd", "é", "z", "q"])).all()
    assert sum(len(d) for d in textvec.steps(pa.array(["x" * 10] * 7), 25)) == 7


def test_tasks_give_their_memory_back(spark):
    import pyarrow as pa

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(textvec._powers)], pa.int32())], ["n"])

    docs = spark.createDataFrame([(i, f"so {ITEM} {i}", "x") for i in range(40)], "doc_id bigint, text string, source string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert decontaminate.clean(docs, bench).count() == 0
    assert neardup.keep_first(docs, 5, 80).count() < 40
    # workers are used again, and hold nothing of the tasks before
    assert {r.n for r in spark.range(64).repartition(8).mapInArrow(held, "n int").collect()} == {0}


def test_canonical_words_need_few_bytes_a_byte():
    """Sums over all bytes of a text are kept one at a time."""
    text = " ".join(f"Word{i % 977} costs {i}.50 kg,\nand Ünit {i} More." for i in range(12_000))
    step = next(iter(textvec.steps(pa.array([text]))))
    units, numbers = textvec.hash_words(decontaminate.UNITS), textvec.hash_words(decontaminate.NUMBER_WORDS)
    decontaminate.Canonical(step, units, numbers)  # powers are kept
    tracemalloc.start()
    try:
        decontaminate.Canonical(step, units, numbers)
        assert tracemalloc.get_traced_memory()[1] < 45 * len(step.data)
    finally:
        tracemalloc.stop()
