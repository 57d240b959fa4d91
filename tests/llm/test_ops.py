"""The training-data operators against brute force on small tables, with nulls, ties, repeats and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, components, embedding_dedup, exact_dedup, language_id, packing, pii, quality, simhash, substring_dedup, toxicity

rnd = random.Random(7)
VOCABULARY = [f"{a}{b}" for a in ("mor", "tal", "vin", "és", "gru") for b in ("an", "el", "ik", "op", "ü")]


def sentence(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rows():
    passage, base = sentence(40), sentence(60)
    out = [(i, sentence(rnd.randint(1, 80))) for i in range(20)]
    out += [(20, None), (21, ""), (22, "   \n"), (23, "A"), (24, "a"), (25, base), (26, "".join(c.upper() if c.isascii() else c for c in base)), (27, base)]
    out += [(28 + i, f"{sentence(20)} {passage} {sentence(20)}") for i in range(4)]
    out += [(40, ("ab cd " * 4000).strip()), (41, "x" * 50_000), (42, "  \x0b tab\tand\nlines  "), (43, base + " " + sentence(1))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns with names that the operators use inside.
    return table(spark, rows).selectExpr("doc_id", "text", "1 as digest", "2 as fp", "3 as n", "4 as seed", "5 as component_id", "6 as shard", "7 as kept")


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(3)).cast("string")])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(docs, rows, digest, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    pick = max if keep == "largest" else min
    want = {i: (pick(groups[lowered(t)]), len(groups[lowered(t)])) for i, t in rows}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs, keep=keep, digest=digest).collect()}
    assert got == want


def test_simhash_and_components(spark, docs, rows):
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    assert fps[20] == fps[21] == fps[22] == 0
    near = [(100 + k, fps[25] ^ sum(1 << b for b in rnd.sample(range(64), k))) for k in range(1, 7)]
    frame = table(spark, [(i, f - (1 << 64) if f >> 63 else f) for i, f in [*fps.items(), *near]], "doc_id long, fp long")
    signed = {r["fp"] for r in frame.collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {(r["u"], r["v"]) for r in simhash.links(frame.select("fp").distinct()).collect()} == want
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(got) == {i for i, _ in rows} and got[21] == got[20] == got[22] == 20 and got[26] == got[27] == got[25]


def test_every_pair_within_four_bits_shares_a_key():
    fuzzy, rng = simhash.FuzzyKeys(), np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.int64)
    y = x.copy()
    for _ in range(4):
        y ^= np.where(rng.random(3000) < 0.9, np.int64(1) << rng.integers(0, 63, 3000), 0)
    (a, i, _), (b, j, _) = fuzzy.keys(x), fuzzy.keys(y)
    assert set(range(3000)) == {r for k, r in set(zip(a.tolist(), i.tolist(), strict=True)) & set(zip(b.tolist(), j.tolist(), strict=True))}


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in components.components(table(spark, pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199}
    assert components.components(table(spark, [], "u long, v long")).count() == 0


def test_language(spark):
    rows = [(i, sentence(40), "xx") for i in range(40)] + [(100 + i, " ".join(rnd.choice(["qua", "zeb", "wok", "jux"]) for _ in range(40)), "yy") for i in range(40)]
    rows += [(200, None, "xx"), (201, "", None), (202, "123 !?", "yy"), (203, "qua zeb wok", None), (204, sentence(5), None)]
    frame = table(spark, rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(frame, model, "doc_id").collect()}
    assert [got[i][0] for i in (200, 201, 202)] == ["und"] * 3
    assert all(got[i][0] == "xx" for i in [*range(40), 204]) and all(got[100 + i][0] == "yy" for i in range(40)) and got[203][0] == "yy"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language_id.fit(frame.filter("false"))
    assert {r["lang_pred"] for r in language_id.predicted(frame, none, "doc_id").collect()} == {"und"}


KIND_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in KIND_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns():
    for _ in range(5000):
        text = "".join(rnd.choice("ab1234567890..@@++-- ()%é\n,") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    rows = [(1, None), (2, ""), (3, "é mail a.b@c.de, 10.0.0.1"), (4, "card 4111 1111 1111 1111"), (5, "tel +49 30 1234567"), (6, "clean text"), (7, "call me: phone (030) 123 45 67"), (8, "name [at] host [dot] com is my email"), (8, "clean")]
    frame = table(spark, rows)
    got = defaultdict(list)
    for r in pii.spans(frame).collect():
        got[r["doc_id"]].append([(s["start"], s["end"], s["kind"]) for s in r["spans"]])
    for i, t in rows[:6]:
        assert set(plain_spans(t or "")) <= set(got[i][0])
    assert got[6] == [[]] and [] in got[8] and len(got[8]) == 2
    masked = {r["text"] for r in pii.masked_text(frame).collect()}
    assert {"é mail <email>, <ip>", "card <card>", "tel <phone>", "clean text", "", None} <= masked


def test_substring(docs, rows):
    def split(t):
        return (t or "").encode().split()

    first = {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t in rows:
        w = split(t)
        covered = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(covered), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in covered)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.deduplicated(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 200


def test_bpe_round_trip_edits_and_tiktoken(docs, rows):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encoded(docs).collect()}
    for i, t in rows:
        assert got[i]["ids"] == ",".join(map(str, known.encode_ordinary(t or ""))) and bytes(got[i]["decoded"]) == (t or "").encode()
    own = bpe.PrefixBPE(ranks)
    for _ in range(300):
        data = bytes(rnd.choice(b"abthein.,\xc3\xa9\xe6\x97") for _ in range(rnd.randint(1, 120)))
        last = own.extend([], data)
        cut = rnd.randrange(len(data))
        edited = data[:cut] + b"the" + data[cut:]
        assert own.walk_back(own.extend(last[:cut], edited)) == own.encode(edited) == own.walk_back(own.extend([], edited))
        assert own.decode(own.encode(data)) == data
    assert base64.b64encode(own.decode([])) == b""


def test_packing(docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed(empty).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = sorted((rnd.randint(1, 64) for _ in range(500)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        r = min(fits) if fits else 64
        rooms.append(r - n)
        want.append(64 - r)
    assert packing.best_fit(lengths, 64)[1] == want


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.01 * rng.standard_normal(16)).tolist(), i % 2) for i in range(20)]
    rows += [(200 + i, base[3].tolist(), 1) for i in range(30)] + [(300, (2 * base[3]).tolist(), 1), (301, base[3].tolist(), 0), (302, base[3].tolist(), None)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] * 16, 1), (405, [1.0, 2.0], 1), (406, [float("inf")] * 16, 1)]
    usable = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    want = defaultdict(set)
    for i, (x, a) in usable.items():
        for j, (y, b) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                want[i].add(j)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table(spark, rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["n_links"] == len(want[i])
        seen, todo = {i}, [i]
        while todo:
            for j in want[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)


def test_levenshtein_matcher_against_dynamic_programming():
    terms = [("idiot", False, 3.0), ("clown", False, 2.0), ("abc", False, 1.0), ("lowei", True, 1.5)]
    matcher = toxicity.Matcher(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(5000):
        word = list(rnd.choice(["idiot", "clown", "abc", "lowei", "loweixyz", "zzz"]))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "x", "o"])
        word = "".join(word)
        exact = [t for t, stem, _ in terms if word == t or stem and word.startswith(t)]
        near = [t for t, stem, _ in terms if not stem and len(t) >= 5 and distance(word, t) <= 1]
        got = matcher._match(word)
        assert bool(got) == bool(exact or near) and (not got or terms[got[0]][0] in (exact or near) and got[1] == (0 if exact else 1)), word


def test_toxicity(spark):
    rows = [(i, sentence(30) + (" idiot clown " if i % 3 == 0 else " ") + sentence(10)) for i in range(150)] + [(200, None), (201, ""), (202, "you idoit clwn idiots clown")]
    frame = table(spark, rows)
    labels = table(spark, [(i, int(i % 3 == 0)) for i in range(120)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(frame, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(150)) and got[200] == got[201] < 0.5 <= got[202]
    nothing = toxicity.fit(frame, labels.filter("false"))
    assert {r["score"] for r in toxicity.scored(frame, nothing).collect()} == {0.0}


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert substring_dedup.deduplicated(empty).count() == 0
    assert bpe.encoded(empty).count() == 0
    assert pii.spans(empty).count() == 0
    assert embedding_dedup.near_duplicates(table(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0
    assert toxicity.scored(empty, toxicity.fit(empty, table(spark, [], "doc_id long, toxic int"))).count() == 0


def test_quality(spark, empty):
    def text(grade):
        return " ".join(w.upper() + "!!" if rnd.random() > grade / 2 else w for w in sentence(60).split())

    rows = [(i, text(i % 3)) for i in range(240)] + [(300, None), (301, ""), (302, "  ")]
    frame = table(spark, rows)
    ratings = table(spark, [(i, i % 3) for i in range(180)] + [(0, None), (None, 2), (1, 0)], "doc_id long, grade int")
    model = quality.fit(frame, ratings, rounds=100)
    got = {r["doc_id"]: r for r in quality.graded(frame, model).collect()}
    assert all(round(got[i]["expected_grade"]) == i % 3 for i in range(180, 240))
    assert all(1 >= r["tails"][0] >= r["tails"][1] >= 0 and abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in got.values())
    assert got[300]["expected_grade"] == got[301]["expected_grade"] == got[302]["expected_grade"]
    assert quality.fit(frame, ratings.filter("grade = 1")) is None
    assert quality.graded(frame, None).first()["expected_grade"] == 0.0 and quality.graded(empty, model).count() == 0


def test_ordinal_gradient_finds_the_thresholds():
    # One feature that says nothing: probabilities are the shares of the grades.
    grade = np.array([0] * 50 + [1] * 30 + [2] * 20)
    model = quality.train(np.zeros(100, np.int64), np.ones(100), np.arange(101), grade, bits=4, rounds=400)
    _, tails = model.grades(float(model.weights[0]))
    assert abs(tails[0] - 0.5) < 0.02 and abs(tails[1] - 0.2) < 0.02
