"""Each operator against a brute-force version, an exact round trip or planted cases, with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import common, compression_language, decontamination, feistel_pseudonyms, golay_dedup, line_dedup, noisy_toxicity, piece_codec, pivot_search, recurrent_lm, resharding
from seqlake.llm.components import components

DOCS = "doc_id long, text string"
random.seed(7)
WORDS = [a + b for a in "ba ce di fo gu ha".split() for b in "lan mer tis von rup sek".split()]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else random
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "") for _ in range(n))


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


EDGE = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "a"), (9004, "a"), (None, "a b c"), (9005, "x " * 20000), (9006, "y" * 30000)]


# -- 1


def leaks_by_brute_force(texts, items):
    words = lambda t: re.findall("[a-z0-9\u0080-￿]+", t.lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    held = {i: words(t) for i, t in items if t}
    df = Counter(s for w in held.values() for s in set(shingles(w)))
    weight = lambda s: 1 / df[s] if s in df else 1
    out = set()
    for d, t in texts:
        w = words(t or "")
        for i, own in held.items():
            if not own or not w:
                continue
            if min(len(w), len(own)) < 5:
                out |= {(d, i)} if w == own else set()
                continue
            c, s, span = Counter(shingles(own)), shingles(w), len(own) - 4
            for a in range(max(1, len(s) - span + 1)):
                x = Counter(s[a : a + span])
                both = sum(min(x[k], n) * weight(k) for k, n in c.items())
                if both / sum(max(x[k], c[k]) * weight(k) for k in set(x) | set(c)) >= 0.8:
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark):
    items = [(i, prose(20 + 3 * i, i)) for i in range(6)] + [(90, None), (91, ""), (92, "two words"), (0, prose(20, 0))]
    texts = list(EDGE) + [(10, "Two, words!"), (11, "here two words stand")]
    for i in range(40):
        own = items[i % 6][1].split()
        if i % 3 == 1:
            own[-1] = "changed"
        if i % 3 == 2:
            own[len(own) // 2 :: 7] = ["x"] * len(own[len(own) // 2 :: 7])
        texts.append((100 + i, f"{prose(i * 5)} {' '.join(own).upper()}*** {prose(30)}"))
    df, bench = docs(spark, texts), docs(spark, items, "item_id long, text string")
    want = leaks_by_brute_force(texts, items)
    for block_bytes in (8_000_000, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench, block_bytes).collect()}
        assert got == want if block_bytes > 300 else {x[0] for x in got} >= {x[0] for x in want}
    kept = decontamination.decontaminate(df.withColumn("similarity", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "similarity"] and {r["doc_id"] for r in kept.collect()} == {t[0] for t in texts} - {x[0] for x in want}
    assert decontamination.find_leaks(df.limit(0), bench).count() == 0 and decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_decontamination_weights_are_of_the_whole_benchmark(spark):
    """Near copies of repeated items and of items with a common template, with equal results whatever the blocks."""
    word = lambda n, i: [f"w{random.Random(i * 1000 + k).randrange(10**6)}" for k in range(n)]
    own, template = word(59, 1), word(40, 2)
    items = [(i, " ".join(own)) for i in range(10)] + [(20 + i, " ".join(word(30, 30 + i) + template)) for i in range(8)] + [(40 + i, " ".join(word(25, 60 + i))) for i in range(20)]
    changed = list(own)
    changed[30] = "changed"
    other = word(30, 30) + template
    other[50] = "changed"  # in the template, which weighs little
    less = word(30, 31) + template
    less[4::5] = ["x"] * len(less[4::5])  # every shingle
    texts = [(1, " ".join(word(7, 99) + changed + word(9, 98))), (2, " ".join(other)), (3, " ".join(template)), (4, " ".join(less)), (5, " ".join(word(25, 60)))]
    df, bench = docs(spark, texts), docs(spark, items, "item_id long, text string")
    whole, small = ({(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in decontamination.find_leaks(df, bench, n).collect()} for n in (8_000_000, 1500))
    assert whole == small
    assert {x[:2] for x in whole} == {(1, i) for i in range(10)} | {(2, 20), (5, 40)}
    assert {x[2:] for x in whole if x[0] == 1} == {(round(50 / 60, 9), 7)}


# -- 2


@pytest.fixture(scope="module")
def model():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    return open(path, "rb").read()


def test_piece_codec(spark, model):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_proto=model)
    alphabet = list("abcdefgh THE  \n\t.,▁é日本😀\x00́ßñ$%#1234\xa0")
    texts = [t for _, t in EDGE] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(500)] + ["thing" * 3000, "  a ", "</s><s>"]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("ids", F.lit("clash"))
    got = piece_codec.decode_documents(piece_codec.encode_documents(df, model), model)
    for r in piece_codec.digests(got).collect():
        ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    codec = piece_codec.PieceCodec(model)
    for ids in ([3 + 0xE6, 3 + 0x97, 300], [3 + 0xFF, 3 + 0xC3, 3 + 0xA9], [1, 28705, 28705, 264, 2], []):
        assert codec.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)
    assert piece_codec.encode_documents(df.limit(0), model).count() == 0


def test_letters_between_spaces_are_kept_once(model):
    """Words of letters only are neither cut nor kept a second time, and have the ids of plain merging."""
    codec = piece_codec.PieceCodec(model)
    words = ["the", "thing", "zqxjv", "été", "straße", "日本語", "a", "don't", "end.", "x1", "²", "ªº"]
    text = " ".join(words)
    assert codec.decode(codec.encode(text)) == text
    assert not any(w.strip(piece_codec.MARK).isalpha() and piece_codec.MARK in w for w in codec.words if w[1:] in words)
    for w in words[:7]:
        merged = codec.merge(piece_codec.MARK + w)
        ids = [i for p in merged for i in ([codec.id_of[p]] if p in codec.id_of else [codec.bytes_at[x] for x in p.encode()])]
        assert codec.parts[w] == np.array(ids, "<u4").tobytes()


# -- 3


def test_recurrent_lm(spark):
    rows = [(i, prose(60, i)) for i in range(300)] + EDGE + [(7, prose(30, 1)), (7, prose(30, 1)), (8, "never SEEN-word")]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    got = recurrent_lm.score(docs(spark, rows), held).collect()
    assert len(got) == len(rows)
    own = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not own(i):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    total, den = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    by = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split() + [None]
        by.setdefault(i, []).append((len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10(counts[w] + 0.1) - den for w in ws), 6)))
    found = {}
    for r in got:
        assert r["train_tokens"] == total and r["held_out"] == own(r["doc_id"]) and r["score"] < 0
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
    for i, want in by.items():
        for a, b in zip(sorted(want), sorted(found[i]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)
    held_rows = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)
    assert recurrent_lm.score(docs(spark, []), held).count() == 0


def test_recurrent_lm_learns_from_all_texts(spark, monkeypatch):
    """All tokens of all training texts, long ones and copies included, train the network, and give words their topics."""
    monkeypatch.setattr(recurrent_lm, "SAMPLE", 5)
    rows = [(i, prose(40, i)) for i in range(200)] + [(300 + i, "copy of one text") for i in range(50)] + [(400, prose(4000, 9)), (401, None)]
    seen, topic = [], {}
    like, made = recurrent_lm.Network.like, recurrent_lm.Model.__init__

    def averaged(net, weights):
        seen.append(weights)
        return like(net, weights)

    def model(self, head, topics, *rest):
        topic.update(topics)
        made(self, head, topics, *rest)

    monkeypatch.setattr(recurrent_lm.Network, "like", averaged)
    monkeypatch.setattr(recurrent_lm.Model, "__init__", model)
    recurrent_lm.score(docs(spark, rows), F.lit(False)).collect()
    assert len(seen) == len(recurrent_lm.ROUNDS) and not np.allclose(seen[0], seen[-1])
    words = {w for _, t in rows for w in (t or "").encode().split()}
    assert set(topic) == words and None not in topic.values()
    assert sorted(k for r in recurrent_lm.ROUNDS for k in r) == list(range(16))


def test_fit_more_reads_every_token():
    texts = [prose(50, i) for i in range(20)] + [prose(9000, 3), ""]
    words = Counter(w for t in texts for w in recurrent_lm.tokens(t))
    model = recurrent_lm.Model(words, {}, sum(words.values()), len(words), len(texts), [(0, 0, 0)] * recurrent_lm.TAILS)
    weights, seen = model.fit_more(iter([texts[:10], texts[10:]]), 0.01)
    assert seen == sum(words.values()) + len(texts) and not np.allclose(weights, model.net.flat())


def test_features_of_texts():
    """Shares of frequent words, as square roots; what has none counts as the first."""
    groups = recurrent_lm.Groups([[b"a", b"b", b"a"], [b"b", b"a"]])
    assert list(groups.frequent) == [b"a", b"b"]
    got = groups.features([[b"a", b"x", b"b", b"a", b"a"], [b"x"], []])
    assert np.allclose(got, [[0.75**0.5, 0.5], [1, 0], [0, 0]])
    assert recurrent_lm.Groups([]).features([[b"x"], []]).tolist() == [[1.0], [0.0]]


def test_recurrent_lm_scores_in_one_pass(spark):
    """Head and tail words come from one reading of the texts, and equal rows, with and without an id, each get the whole score."""
    rows = [(i, prose(20, i)) for i in range(40)] + [(7, "seen once_only"), (7, "seen once_only"), (None, "seen never-else"), (None, "seen never-else"), (None, None)]
    scored = recurrent_lm.score(docs(spark, rows), F.coalesce(F.col("doc_id") == 3, F.lit(False)))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = scored.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] in (7, None)) == [(False, 7, 3), (False, 7, 3), (False, 7, 21), (True, None, 1), (True, None, 3), (True, None, 3)]
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 7}) == 2


def test_network_gradients():
    net = recurrent_lm.Network(5)
    for w in net.weights():
        w[:] = w.astype(np.float32)
    lanes, begins = [np.array([0, 1, 2, 3, 4] * 8)], [np.array([True] + [False] * 39)]
    inputs = np.vstack([[[5]], lanes[0][:-1, None]])
    fresh = begins[0][:, None]
    loss = lambda: -net.log_probabilities(net.run(inputs, fresh, np.zeros((1, recurrent_lm.HIDDEN), np.float32))[0], lanes[0][:, None]).mean()
    before = loss()
    net.train(lanes, begins, epochs=60)
    assert loss() < 0.2 < before  # it learns the cycle
    a = net.run(inputs, fresh, np.zeros((1, recurrent_lm.HIDDEN), np.float32))[0]
    first, state = net.run(inputs[:17], fresh[:17], np.zeros((1, recurrent_lm.HIDDEN), np.float32))
    assert np.allclose(a, np.vstack([first, net.run(inputs[17:], fresh[17:], state)[0]]), atol=1e-6)  # the state is carried across windows


# -- 4


def test_resharding(spark, tmp_path):
    rows = [(i, prose(random.randint(1, 60)), f"s{i % 3 if i % 2 else 0}") for i in range(800)] + [(i, t, None) for i, t in EDGE[:6]]
    df = docs(spark, rows, DOCS + ", source string")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(8))
    got = resharding.reshard(df, old, 8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 200
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    text = {i: t or "" for i, t, _ in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    before = Counter()
    for r in got:
        before[r["old_shard"]] += r["size"]
    moved = sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    least = sum(max(0, before[s] - sum(sizes.values()) // 8) for s in range(8))
    assert moved < least + 2000
    changed = resharding.rewrite(df, old, 8, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["shard"], r["doc_id"], r["text_crc32"]) for r in got if r["shard"] in changed}
    assert {(r["shard"], r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in back.collect()} == want
    assert resharding.reshard(df.limit(0), old, 8).count() == 0


def test_rewrite_keeps_other_shards(spark, tmp_path):
    """On an existing layout: shards that nothing leaves or enters keep their files, and no document is lost."""
    to = str(tmp_path / "layout")
    rows = [(i, f"text {i:04d}", 0 if i < 300 else 1 if i < 500 else 2) for i in range(600)]
    docs(spark, rows, DOCS + ", shard int").write.partitionBy("shard").parquet(to)
    files = sorted((tmp_path / "layout" / "shard=1").iterdir())
    now = spark.read.parquet(to)
    assert resharding.rewrite(now, F.col("shard"), 3, to) == [0, 2]
    back = spark.read.parquet(to)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [r[:2] for r in rows]
    assert sorted((tmp_path / "layout" / "shard=1").iterdir()) == files
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 200, 1: 200, 2: 200}
    assert not [p for p in (tmp_path / "layout").iterdir() if p.name.startswith("_resharding")]
    # a shard beyond the new number is emptied and goes; documents without an old shard come in
    new = spark.read.parquet(to).unionByName(docs(spark, [(1000 + i, "new one", None) for i in range(50)] + [(None, None, None)], DOCS + ", shard int"))
    assert resharding.rewrite(new, F.col("shard"), 2, to) == [0, 1, 2]
    back = spark.read.parquet(to).collect()
    assert len(back) == 651 and {r["shard"] for r in back} == {0, 1} and {r["doc_id"] for r in back} == {*range(600), *range(1000, 1050), None}


def test_resharding_without_old_shard(spark):
    df = docs(spark, [(i, prose(9), i % 3 or None) for i in range(90)], DOCS + ", s int")
    got = resharding.reshard(df, F.col("s"), 2).collect()
    assert len(got) == 90 and sum(r["old_shard"] is None for r in got) == 30


def test_min_cost_flow():
    assert resharding.min_cost_flow([5, 1], [3, 3], lambda i, j: int(i != j)) == {(0, 0): 3, (0, 1): 2, (1, 1): 1}
    for _ in range(20):
        supply = [random.randint(0, 20) for _ in range(4)]
        cap = [sum(supply) // 3 + (j < sum(supply) % 3) for j in range(3)]
        flow = resharding.min_cost_flow(supply, cap, lambda i, j: int(i != j))
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(4)] == supply
        stay = sum(min(supply[k], cap[k]) for k in range(3))
        assert sum(x for (i, j), x in flow.items() if i != j) == sum(supply) - stay
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], lambda i, j: 0)


# -- 5


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def linked(prints):
    at = list(range(len(prints)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_golay_decoding():
    g = golay_dedup.golay()
    w = np.array([random.getrandbits(23) for _ in range(500)], np.int64)
    c = w ^ g.error[g.syndromes(w)]
    assert (g.syndromes(c) == 0).all() and (np.bitwise_count((c ^ w).astype(np.uint64)) <= 3).all()


@pytest.mark.parametrize("hot", [golay_dedup.HOT, 2])
def test_golay_links(spark, hot):
    """All links of planted fingerprints within three bits are found, whatever the segments that differ."""
    prints = [random.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for _ in range(4):
            prints.append(p ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 3))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r["u"]: r["root"] for r in components(golay_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot)).collect()}
    groups = {}
    for s, r in zip(signed, linked(prints), strict=True):
        groups.setdefault(r, []).append(s)
    for own in groups.values():
        assert {got.get(s, s) for s in own} == {min(own)}


def test_golay_dedup(spark):
    rows = [(i, prose(80, i)) for i in range(30)] + [(50 + i, prose(80, i)) for i in range(10)] + [(100 + i, prose(80, i) + " x") for i in range(10)] + EDGE
    df = docs(spark, rows).withColumn("fp", F.lit(1))
    got = golay_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        assert r["fingerprint"] == format(slow_fingerprint(texts[r["doc_id"]]), "016x")
    roots = linked([int(r["fingerprint"], 16) for r in got])
    for k in set(roots):
        own = [r for r, x in zip(got, roots, strict=True) if x == k]
        assert {r["component_id"] for r in own} == {min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)}
    kept = golay_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert golay_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (41, 40)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(1, 42)}, **{i: 100 for i in range(101, 140)}}


# -- 6


def lines_by_brute_force(rows):
    seen, out = [], {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t in order:
        keep = []
        for line in (t or "").split("\n"):
            w = frozenset(x for x in re.split(r"[ \t\r\x0b\f]+", line.lower()) if x)
            if len(w) >= 5:
                if any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for v in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            keep.append(line)
        out[i] = t if t is None else "\n".join(keep)
    return out


@pytest.mark.parametrize("crowd,long", [(line_dedup.CROWD, line_dedup.LONG), (3, line_dedup.LONG), (3, 20)])
def test_line_dedup(spark, crowd, long):
    base = [prose(25, i) for i in range(6)]
    rows = [(1, None), (2, ""), (3, "a b c\n\n" + base[0]), (5, "x y z q w " * 3000)]
    for i in range(60):
        own = base[i % 6].split()
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = random.choice(WORDS)
        rows.append((10 + i, f"{prose(12, 1000 + i)}\n{' '.join(own).title()}\na b c\n{prose(9, 2000 + i % 40)}"))
    df = docs(spark, [(i, t, 0) for i, t in rows], DOCS + ", n_chars long").withColumn("d", F.lit("clash"))
    got = line_dedup.dedup_lines(df, line_dedup.removed_lines(df, crowd, long))
    want = lines_by_brute_force(rows)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert got.columns == [*df.columns, "n_removed"] and got.where("n_removed > 0 and n_chars <> length(text)").count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


def test_line_dedup_sorts_plain_numbers(spark):
    """Tokens of a written table are ordered by rarity as numbers that can't be null."""
    sets = common.written(line_dedup._sets(docs(spark, [(1, "one two three four five six")])))
    own = line_dedup._own(sets, line_dedup._classes(sets)[0])
    assert sets.schema["t"].dataType.containsNull and not own.schema["p"].dataType.containsNull
    assert [r["p"] for r in own.collect()] == [sorted(r["p"]) for r in own.collect()]


def test_line_dedup_counts_a_share(spark, monkeypatch):
    """Tokens are counted in a share of a large table's lines, which changes the order of the tokens but not what goes."""
    rows = []
    for i in range(60):
        own = prose(20, 500 + i % 12).split()
        own[random.randrange(len(own))] = random.choice(WORDS)
        rows.append((i, f"{prose(12, 900 + i % 50)}\n{' '.join(own)}\na b c"))
    df = docs(spark, rows)
    sets = common.written(line_dedup._sets(df)).where("size(t) >= 5")
    whole = line_dedup._classes(sets)
    monkeypatch.setattr(line_dedup, "COUNTED", 30)
    assert line_dedup._classes(sets)[0] != whole[0]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == lines_by_brute_force(rows)


def test_line_dedup_counts_all_lines(spark):
    """However many lines a table has, the tokens of every one are counted: here a share by the sets' hash would see none."""
    sets = spark.range(250_000).selectExpr("2 * id + 1 as s", "array(5) as t")
    classes, crowded = line_dedup._classes(sets)
    seen = spark.sql(f"select {classes}[0] as n").first()["n"]
    assert seen == round(4 * math.log2(1 + 250_000)) and seen >= crowded


def test_line_dedup_empty_and_repeated(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "one two three four five"), (2, "five\ttwo three  four one")]).selectExpr("*", "7 as n_removed", "'a' as d", "'b' as V", "'c' as bits", "'d' as `x.y`")
    got = line_dedup.dedup_lines(clash).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "one two three four five", "a", "b", "c", "d", 0), (2, "", "a", "b", "c", "d", 1)]
    twice = docs(spark, [(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four five")])
    assert sorted((r["doc_id"] or 99, r["text"]) for r in line_dedup.dedup_lines(twice).collect()) == [(1, "one two three four five")] * 2 + [(99, "")]


# -- 7


def test_pseudonyms(spark):
    text = "mail ann.lee99@mail.example.com, card 4111 1111 1111 1111 or 4111111111111112, ip 10.2.3.4 not 300.1.1.1, ssn 123-45-6789 or 000-12-3456, on 2024-02-29 and 2023-02-30, 29.02.2024, +1 (212) 555-0199, DE89370400440532013000, key 0123456789abcdef0123456789abcdef."
    rows = [(1, text), (2, f"again: {text}"), (3, None), (4, ""), (5, "no data 12 here"), (6, "z" * 50000)]
    df = docs(spark, rows)
    a = {r["doc_id"]: r for r in feistel_pseudonyms.pseudonymise(df, "k1").collect()}
    b = {r["doc_id"]: r for r in feistel_pseudonyms.pseudonymise(df, "k2").collect()}
    new = a[1]["text"]
    assert a[2]["text"] == f"again: {new}" and b[1]["text"] != new and a[3]["text"] is None and a[4]["text"] == "" and a[5]["text"] == rows[4][1] and a[6]["text"] == rows[5][1]
    for gone in ("ann.lee99", "4111 1111 1111 1111", "10.2.3.4", "123-45-6789", "2024-02-29", "29.02.2024", "555-0199", "DE89370400440532013000", "0123456789abcdef"):
        assert gone not in new
    for kept in ("4111111111111112", "300.1.1.1", "000-12-3456", "2023-02-30", "@mail.example.com"):
        assert kept in new
    again = {r["doc_id"]: r for r in feistel_pseudonyms.pseudonymise(docs(spark, [(1, new)]), "k1").collect()}
    assert again[1]["n_replaced"] == a[1]["n_replaced"] == 9  # what was valid still is
    assert feistel_pseudonyms.pseudonymise(df.limit(0), "k").count() == 0
    clash = feistel_pseudonyms.pseudonymise(docs(spark, [(1, text)]).selectExpr("*", "'a' as found", "'b' as new", "'c' as __found", "9 as n_replaced"), "k1").first()
    assert (clash["text"], clash["found"], clash["new"], clash["__found"], clash["n_replaced"]) == (new, "a", "b", "c", 9)


def test_pseudonyms_of_secrets(spark):
    """Keys in capitals, in both cases and of more than 64 digits; a key in capitals goes the way of the same key in small letters."""
    keys = ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "0123456789abcdef" * 8, "0123456789ABCDEF" * 8, "aB1C" * 10, "f" * 65]
    keys += ["0" * 40, "aB1C" * 9 + "aB1D"]
    kept = ["9233A8ECF7C5B09FE5949719B6B82BC", "x" + keys[0], keys[1] + "z"]
    got = {r["doc_id"]: r for r in feistel_pseudonyms.pseudonymise(docs(spark, [(i, f'"{k}"!!') for i, k in enumerate(keys + kept)]), "k").collect()}
    new = [got[i]["text"][1:-3] for i in range(len(keys + kept))]
    assert [got[i]["n_replaced"] for i in range(len(new))] == [1] * len(keys) + [0] * len(kept) and new[len(keys) :] == kept
    for k, n in zip(keys, new):  # noqa: B905
        assert n != k and len(n) == len(k) and re.fullmatch("[0-9a-f]+" if k == k.lower() else "[0-9A-F]+" if k == k.upper() else "[0-9A-Fa-f]+", n)
    assert new[0] == new[1].upper() and new[3] == new[2].upper() and len(set(new)) == len(new)
    assert [re.sub("[a-f]", "a", re.sub("[A-F]", "A", re.sub("[0-9]", "0", x))) for x in (new[4], new[7])] == ["aA0A" * 10] * 2


def test_feistel_is_a_permutation(spark):
    nums = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    got = [r[0] for r in nums.select(feistel_pseudonyms.digits(F.lit("k"), "t", F.col("s"))).collect()]
    assert sorted(got) == [f"{i:03d}" for i in range(1000)] and got != sorted(got)
    days = spark.range(0, 146097, 1).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    out = days.select(feistel_pseudonyms.pseudonym(F.lit("k"), F.col("v")).alias("p"))
    assert out.distinct().count() == 146097


# -- 8


def test_toxicity(spark):
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(600):
        t = prose(40, i).split()
        if i % 3 == 0:
            t[5] = random.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, "you 1d10t " + prose(30, 5)), (1001, "a m o r o n there " + prose(30, 6)), (1002, "iiiidiooot " + prose(30, 7)), (1003, prose(30, 8))] + [(2000 + k, t) for k, (_, t) in enumerate(EDGE)]
    labels += [(0, 1), (5000, 1), (7, None), (None, 1)]
    df, lab = docs(spark, rows).withColumn("score", F.lit("clash")), docs(spark, labels, "doc_id long, toxic int")
    model = noisy_toxicity.learn(df, lab, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in noisy_toxicity.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(600))
    assert min(got[i] for i in (1000, 1001, 1002)) > 0.5 > max(got[1003], got[2000], got[2001])
    kept = {r["doc_id"] for r in noisy_toxicity.reject(df, model).collect()}
    assert kept == {i for i, x in got.items() if x < 0.5}
    nothing = noisy_toxicity.learn(df, lab.limit(0), F.lit(True))
    assert {r["score"] < 0.01 for r in noisy_toxicity.score(df, nothing).collect()} == {True}
    assert noisy_toxicity.score(df.limit(0), model).count() == 0
    assert model.model.restore("1d10t") == "idiot"
    assert model.model.restore("1d10t" + "." * 70) == "idiot" and model.model.restore("m o r o n") == "moron"


def test_toxicity_learns_from_all_texts(spark):
    """Lexicon and regression count every labelled text, more than some thousand and long ones too."""
    n_toxic, n_other = 1500, 3000
    rows = [(i, f"{prose(5, i)} idiot") for i in range(n_toxic - 12)] + [(i, prose(4000, i) + " scumbag") for i in range(n_toxic - 12, n_toxic)]
    rows += [(i, prose(5, i) + (" idiot" if i % 100 == 0 else "")) for i in range(n_toxic, n_toxic + n_other)]
    assert min(len(t) for _, t in rows[n_toxic - 12 : n_toxic]) > 20_000
    df, lab = docs(spark, rows), docs(spark, [(i, int(i < n_toxic)) for i, _ in rows], "doc_id long, toxic int")
    model = noisy_toxicity.learn(df, lab, F.lit(True))
    for word, pos, neg in (("=idiot", n_toxic - 12, 30), ("=scumbag", 12, 0)):
        odds = math.log((pos + 0.5) / (n_toxic + 1)) - math.log((neg + 0.5) / (n_other + 1))
        assert abs(model.odds[word] - odds) < 1e-9
    assert model.model.tri["bag"] == 12 and model.model.tri["iot"] == n_toxic - 12 + 30
    assert model.score(prose(8, 1) + " scumbag") > 0.5 > model.score(prose(8, 2))


def test_restored_words_are_searched_once():
    """A word with and without signs around it is one search; trigrams and runs of single letters are found without going letter by letter."""
    from collections import Counter

    model = noisy_toxicity.CharModel(Counter({"idiot": 9, "moron": 7}))
    searched, best = [], model.best
    model.best = lambda s: searched.append(s) or best(s)
    found = noisy_toxicity.Toxicity(model, {"=idiot": 3.0}, [0.0, 1.0, 0.0, 0.0])
    assert [found.worth(w) for w in ("1d10t", "1d10t.", "(1d10t)", "1d10t", "..", "-")] == [3.0, 3.0, 3.0, 3.0, 0.0, 0.0]
    assert searched == ["1d10t", "(1d10t"]
    found.forget()
    assert not model.restored and not model.restored.before
    words = Counter({"straße": 2, "a": 3, "b-c": 5, "日本": 1, "𝒳y": 4})
    tri = Counter()
    for w in ("straße", "a", "日本", "𝒳y"):
        for i in range(len(w) + 1):
            tri[f"^^{w}$"[i : i + 3]] += words[w]
    assert noisy_toxicity.grams(words) == tri and not noisy_toxicity.grams(Counter({"1": 1}))
    assert "idiot" in noisy_toxicity.words_of("an\ni d i o\tt there", model) and noisy_toxicity.words_of("a b cd e", model) == ["a", "b", "cd", "e"]


def test_lattice_against_enumeration():
    """The search finds the cheapest of all readings, which are listed one by one."""
    from collections import Counter

    model = noisy_toxicity.CharModel(Counter({"idiot": 9, "moron": 7, "you": 20, "are": 20, "a": 30, "too": 5, "toot": 2}))

    def readings(s, last="^^"):
        if not s:
            yield (model.cost(last + "$") if last != "^^" else 0.0), ""
            return
        for more, key, x in model.steps(s[0], last):
            for cost, rest in readings(s[1:], key):
                yield more + cost, x + rest

    random.seed(8)
    for _ in range(60):
        s = "".join(random.choice("idot10!@m 7") for _ in range(random.randint(1, 7)))
        cost, text = model.best(s)
        found = sorted(readings(s))
        assert abs(found[0][0] - cost) < 1e-9 and any(abs(c - cost) < 1e-9 and t == text for c, t in found)


# -- 9


def test_language(spark):
    syllables = {"aa": "ka lo mi tu ne", "bb": "sch ung ver ent lich", "cc": "oua eau tre ill ent"}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(80)), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, rows[1][1] * 30, None)]
    df = docs(spark, rows, DOCS + ", lang string")
    train = F.col("doc_id") % 4 != 2
    got = {r["doc_id"]: r for r in compression_language.predict(df, compression_language.learn(df, train)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] and 0 <= got[i]["score"] <= 1 for i in range(240))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert {r["lang_pred"] for r in compression_language.predict(df, {}).collect()} == {"und"}
    assert compression_language.predict(df.limit(0), compression_language.learn(df.limit(0), train)).count() == 0


def test_languages_with_copies_long_texts_and_many(spark):
    syllables = {"aa": "ka lo mi tu ne", "bb": "sch ung ver ent lich"}
    text = lambda lang, i, n=80: " ".join("".join(random.Random(i * 1000 + k).choices(syllables[lang].split(), k=2)) for k in range(n))
    # 20,000 copies of one text beside 30 others; long texts only; more languages than 400
    rows = [(i, text("aa", i), "aa") for i in range(30)] + [(100 + i, text("bb", i, 4000), "bb") for i in range(2)]
    rows += [(1000 + i, f"word{chr(97 + i % 26)} other{chr(97 + i // 26)}", f"l{i:03d}") for i in range(420)]
    copies = spark.range(20_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the one text").alias("text"), F.lit("aa").alias("lang"))
    got = compression_language.learn(docs(spark, rows, DOCS + ", lang string").unionByName(copies), F.lit(True))
    assert len(got) == 422
    assert all(compression_language.plain(t) in got["aa"] for _, t, lang in rows if lang == "aa") and got["aa"].count(b"the one text") == 1
    assert len(got["bb"]) > 50_000
    only = compression_language.learn(docs(spark, [(1, "12 34", "n")] + [(i, "same words", "m") for i in range(9)], DOCS + ", lang string"), F.lit(True))
    assert only == {"m": b"same words"}


def test_language_without_letters_and_with_marks(spark):
    rows = [(1, "12 ²"), (2, "½"), (3, "①"), (4, "Ⅷ"), (5, "हिन्दी भाषा"), (6, None), (5, "हिन्दी भाषा")]
    df = docs(spark, rows).withColumn("lang", F.lit("hi")).withColumn("score", F.lit("clash"))
    made = compression_language.learn(df, F.lit(True))
    got = compression_language.predict(df, made).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "und", 2: "und", 3: "und", 4: "und", 5: "hi", 6: "und"} and len(got) == 7
    assert compression_language.plain("हिन्दी") == "हिन्दी".encode()


# -- 10


def test_pivot_search(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=12).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 12) for i in range(60)] + [(2000, None), (2001, [None] + [0.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2020, [0.5, -0.5]), (2040, []), (None, [0.5] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in pivot_search.top_k(df.withColumn("vec", F.lit(1)), F.col("vec_id") % 20 == 0, pivots=6, block_rows=16).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    sound = {i: np.floor(np.array((v + [0.0] * 12)[:12]) * 64).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert set(got) == {i for i in sound if i % 20 == 0}
    for i, found in got.items():
        want = sorted((-int(sound[i] @ v), j) for j, v in sound.items() if j != i)[:20]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert pivot_search.top_k(df.limit(0), F.lit(True)).count() == 0
    few = pivot_search.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [x["rank"] for x in few] == [1, 2]


def test_shared_dir(spark):
    class Conf:
        def __init__(self, there):
            self.there = there

        def get(self, key, default=None):
            return self.there if key == "spark.checkpoint.dir" else default

    def session(master, there):
        chosen = SimpleNamespace(isEmpty=lambda: False)
        jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: chosen))
        return SimpleNamespace(conf=Conf(there), sparkContext=SimpleNamespace(master=master, getConf=lambda: Conf(None), _jsc=jsc))

    assert common.shared_dir(session("spark://x:7077", "hdfs://x/shared")) == "hdfs://x/shared"
    assert common.shared_dir(session("local[2]", None))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session("spark://x:7077", None))
    assert common.written(spark.range(3)).count() == 3
