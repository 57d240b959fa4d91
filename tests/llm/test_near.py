"""The near stage of the pipeline against the similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from paperloom.llm import shingle_dedup, simhash


def plain_set(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    sets, component = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * shared >= 4 * total and component[i] != component[j]:
                component = [component[j] if c == component[i] else c for c in component]
    least = {}
    for (i, _), c in zip(rows, component, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted((str(i), t or "") for (i, t), c in zip(rows, component, strict=True) if i is None or i == least[c])


def table():
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("mor", "tal", "vin", "és") for b in ("an", "el", "ik") for c in ("a", "o", "us")]
    sentence = lambda n: [rnd.choice(words) for _ in range(n)]

    def edited(text, edits):
        text = list(text)
        for at in rnd.sample(range(len(text)), edits):
            text[at] = rnd.choice(words)
        return text

    texts = []
    for _ in range(40):
        base = sentence(rnd.randint(8, 250))
        texts += [base, *(edited(base, rnd.randint(1, 1 + len(base) // 30)) for _ in range(rnd.randint(0, 3)))]
    hot = sentence(60)  # copies with one word changed are like the text, but most are not like one another
    texts += [edited(hot, 1) for _ in range(120)] + [hot] + [edited(hot, 2) for _ in range(30)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (None, rows[3][1]), (5, sentence(30)[0]), (5, " ".join(sentence(40)))]


@pytest.mark.parametrize("few", [4, 0])
def test_near_stage_equals_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(shingle_dedup, "FEW", few)  # 0: by rounds as far as they go
    rows = table()
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == plain_kept(rows)


def test_near_stage_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near(spark, docs, "").count() == 0


def test_texts_of_a_template_do_not_meet(spark, monkeypatch):
    """Most of their words are shared, but they are no duplicates: what is compared grows with the rows, not with their square."""
    met = []
    counted = shingle_dedup._all_pairs

    def all_pairs(members, sketches, groups):
        met.append(sum(r["count"] ** 2 for r in members.groupBy("key").count().collect()))
        return counted(members, sketches, groups)

    monkeypatch.setattr(shingle_dedup, "_all_pairs", all_pairs)
    monkeypatch.setattr(shingle_dedup, "PAIRS_A_SHINGLE", 1)  # so that tables of this size are enough
    rnd = random.Random(2)
    template = [f"t{rnd.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(template + [f"o{rnd.randrange(10**9)}" for _ in range(50)]) for _ in range(600)]
    copies = [t + " end" for t in texts[:3]]
    sizes = {}
    for n in (150, 300, 600):
        met.clear()
        rows = list(enumerate(texts[:n] + copies))
        found = {r["doc_id"] for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {0, 1, 2, n, n + 1, n + 2}
        sizes[n] = sum(met)
    # One bucket of all of them would hold 360,000 pairs, and there were 40 keys.
    assert sizes[600] <= 3 * max(sizes[300], 200), sizes


def test_recall_just_above_the_similarity(spark):
    rnd, rows, pairs = random.Random(4), [], 0
    while pairs < 400:
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 300))]
        other = list(base)
        for at in rnd.sample(range(len(base)), max(1, round(len(base) * 0.021))):
            other[at] = f"x{rnd.randrange(5000)}"
        a, b = plain_set(" ".join(base)), plain_set(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    found = shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("not kept and doc_id % 2 = 1").count()
    assert found >= 0.99 * pairs


def test_near_texts_are_found_by_their_fingerprints(spark, monkeypatch):
    """By the method of operator 2 alone: all similar texts whose fingerprints differ in at most 4 bits are linked, and no unlike ones."""
    monkeypatch.setattr(shingle_dedup, "_by_minhash", lambda nodes: shingle_dedup.written(nodes.filter("false").selectExpr("node key", "node", "node component"), "none"))
    rows = [(i, t) for i, t in table() if i is not None and i != 5]
    got = {r["doc_id"]: r["component"] for r in shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: plain_set(t) for i, t in rows}
    prints = {i: simhash.bit_majority(shingle_dedup.shingles(t)) for i, t in rows}
    near, every = 0, {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                every = {k: every[i] if c == every[j] else c for k, c in every.items()}
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    assert got[i] == got[j]
                    near += 1
    assert near >= 50
    assert all(every[i] == every[j] for i, c in got.items() for j, d in got.items() if c == d)


def test_texts_linked_by_their_fingerprints_are_not_paired_again(spark, monkeypatch):
    """The wider keys come after the fingerprints and start from their components."""
    before = []
    connected = shingle_dedup._connected

    def record(members, sketches, texts, labels, **further):
        before.append(None if labels is None else labels.count())
        return connected(members, sketches, texts, labels, **further)

    monkeypatch.setattr(shingle_dedup, "_connected", record)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:-1] + ["x"])), (2, "another text of a few words")]
    found = shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == {0: True, 1: False}
    assert before == [None, 2]


def test_fuzzy_keys_of_near_fingerprints(spark):
    rnd = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for i in range(500):
        fp = rnd.getrandbits(64)
        rows += [(signed(fp), i), (signed(fp ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))), i)]
    keys = {}
    for r in simhash.fuzzy_keys(spark.createDataFrame(rows, "fp long, node long"), "node").collect():
        keys.setdefault((r["fp"], r["node"]), set()).add(r["key"])
    assert all(keys[rows[i]] & keys[rows[i + 1]] for i in range(0, len(rows), 2))
