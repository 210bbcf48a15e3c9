"""Each operator on awkward rows, and against plain Python where SQL can't say it."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causalnet.llm import langid, media, mixing, packing, pii, quality, queries, rules, simhash, substring, token_ids
from causalnet.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, fp int, k int, n string, size double"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, text(60)), (4, text(60)), (4, text(60)), (5, "x" * 30_000), (6, text(9000))]
    same = text(80)
    rows += [(7, same), (7, same), (8, same), (9, same.replace("w1 ", "w2 ", 1))]
    full = [(i, t, None if i in (2, 4) else "en", None if i == 5 else "s1", None, 1, "a", 2, 3, "b", 0.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(df):
    return collections.Counter(r[0] for r in df.collect())


def test_encoder_equals_library():
    r = random.Random(1)
    parts = ["a", "the", "Éa", "ñ", "'s", "don't", " ", "  ", "\n", "\t", "\n\n", ".", ",", "!!", "&&&", "12", "日本", "ΣΑΣ", "<|endoftext|>", "\x00", "\xa0", "ß", "\x1c"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, fresh = Encoder(queries.tokenizer_path(name), remembered=50), Tokenizer.from_file(queries.tokenizer_path(name))
        for _ in range(1500):
            t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
            assert e.encode(t).tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


def test_elias_fano():
    r = random.Random(2)
    for _ in range(50):
        v = np.cumsum([r.choice([0, 1, 5, 300]) for _ in range(r.randint(1, 300))])
        e = token_ids.EliasFano.build(v)
        assert [e.select(i) for i in range(len(v))] == v.tolist()
        for _ in range(20):
            i, j = sorted((r.randint(0, len(v)), r.randint(0, len(v))))
            assert e.select_range(i, j).tolist() == v[i:j].tolist()
    long = np.cumsum(np.full(100_000, 700))
    assert token_ids.EliasFano.build(long).size() < 100_000 * 14 / 8  # under 14 bits each


@pytest.mark.parametrize("most", [1 << 26, 3000])
def test_token_ids(spark, docs, empty, most):
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(-(1 << 63)).cast("long")))
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = token_ids.read_token_ids(token_ids.tokenize_to_shards(spark, docs, path, shard_tokens=most), docs=3, ids=500).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    at, want = 0, []
    for i, x in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda p: (p[0] is not None, 0 if p[0] is None else p[0], p[1] is not None, p[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_ids.read_token_ids(token_ids.tokenize_to_shards(spark, empty, path)).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[2] == by[3] == 1 and by[8] == by[7] == 7
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 8 not in ids_of(kept.select("doc_id"))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base[r.integers(0, 40, 60)] ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5))]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    from causalnet.llm.shared import connected_components

    want = list(range(len(fp)))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
            a, b = want[i], want[int(j)]
            if a != b:
                want = [min(a, b) if w == max(a, b) else w for w in want]
    sizes = sorted(collections.Counter(want).values())
    for most in (20_000, 2):
        comp = {q["node"]: q["component"] for q in connected_components(simhash.links(df, most=most)).collect()}
        assert sorted(collections.Counter(comp.get(int(x), int(x)) for x in fp.view(np.int64)).values()) == sizes


def test_packing(docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    got = packing.packed(packing.token_pieces(docs, path)).orderBy("sequence_id", "offset").collect()
    room = collections.defaultdict(int)
    for p in got:
        assert p["offset"] == room[p["sequence_id"]] and 1 <= p["length"] <= 4096 and len(p["ids"]) == 2 * p["length"]
        room[p["sequence_id"]] += p["length"]
    assert max(room.values()) <= 4096 and len(room) <= -(-sum(room.values()) // 4096) + 1
    assert packing.packed(packing.token_pieces(empty, path)).count() == 0
    lengths = np.array([10, 9, 8, 2, 1, 1, 5])
    for rule in ("norm", "dot"):
        b, o = packing.best_fit(lengths, 12, 3, 150.0, (1, 1, 1), rule)
        for k in set(b):
            assert lengths[b == k].sum() <= 12 and (b == k).sum() <= 3 and (lengths[b == k] ** 2).sum() <= 150


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == docs.count() and sum(r["size"] * r["epochs"] for r in got) <= 1.5 * total + 1 and max(r["epochs"] for r in got) <= 2
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(empty).count() == 0
    r = queries.op8_mixing(spark, SF).toPandas()
    r["source"] = r["target"]
    for target, g in r.groupby("target"):
        assert abs(g["taken"].sum() / max(1, len(g["source"].unique())) - target) <= 2 * g["size"].max() + 1 or g["source_size"].nunique() > 1


def brute_rules(t):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t or "")
    lines = [x for x in (t or "").split("\n") if word.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    at = {j for i in range(len(w) - 2) if seen[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(at)


def test_rules(spark, docs, empty):
    more = spark.createDataFrame([(50, "a b c d " * 2000), (51, "x y z\nx y z\n#% é é é é é"), (52, " ".join(f"a{i} b{i} c{i} a{i} b{i} c{i}" for i in range(40)))], "doc_id long, text string")
    every = docs.select("doc_id", "text", "lang").unionByName(more, allowMissingColumns=True)
    got = collections.Counter(tuple(r)[:1] + (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.judge(every).collect())
    assert got == collections.Counter((r["doc_id"], *brute_rules(r["text"])) for r in every.collect())
    assert rules.judge(empty).count() == 0
    j = queries.op5_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in j]) > 0.97


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    j = queries.op1_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in j]) > 0.9
    assert quality.classify(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.kept_documents(docs, labels.limit(0)).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0


def test_langid(spark, docs, empty):
    j = queries.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in j]) > 0.95
    got = {r["id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == "und" and langid.identify(empty).count() == 0
    code = langid.codewords(12)
    assert min(np.sum(code[a] != code[b]) for a in range(12) for b in range(a)) >= 5


def test_media(docs, empty):
    got = media.read_media(media.store(docs)).collect()
    want = collections.Counter()
    for r in docs.collect():
        p = (r["text"] or "").encode()
        n = len(p)
        p += bytes(-n % 64 or (0 if n else 64))
        want[(r["doc_id"], n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    forms = collections.defaultdict(set)
    for r in got:
        forms[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in forms.values())
    import zstandard

    for t in ("", "x" * 30_000, "ab c" * 5000):  # the stored form, chunk by chunk
        p, z = media.payload(t)[0], zstandard.ZstdCompressor(3)
        parts = [p[i:j] for i, j in zip([0, *media.cuts(p)], media.cuts(p))]
        frames = [z.compress(x) for x in parts]
        form = b"".join(hashlib.sha256(x).digest() + struct.pack("<II", len(x), len(f)) for x, f in zip(parts, frames)) + b"".join(frames)
        row = media.read_media(media.store(docs.limit(1).withColumn("text", F.lit(t)))).collect()[0]
        assert (row["media_bytes"], row["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
    assert media.read_media(media.store(empty)).count() == 0
    a = bytes(random.Random(1).randbytes(60_000))
    x, y = ({a[i:j] for i, j in zip([0, *c], c)} for c in [media.cuts(a)] * 2)
    b = a[:30_000] + b"!" + a[30_000:]
    y = {b[i:j] for i, j in zip([0, *media.cuts(b)], media.cuts(b))}
    assert len(x - y) <= 3
    h = 0
    for v in a[:500]:
        h = (2 * h + int(media.GEAR[v])) & 0xFFFFFFFF
    assert int(media.rolling(np.frombuffer(a[:500], np.uint8))[-1]) == h


def test_substring(spark, empty):
    r = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))
    passage, line = text(60), " ".join(r.choice(words) for _ in range(80))
    near = line.split()
    near[40] = "zz"
    rows = [(i, f"{text(80)}. {passage} {text(80)}" if i < 10 else text(200)) for i in range(30)]
    rows += [(100, "head\n" + line), (101, " ".join(near) + "\nfoot"), (102, None), (None, "a b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (2000, 1):
        got = substring.repeated_passages(d, most=most)
        assert {q["doc_id"] for q in got.collect()} == {*range(10), 100, 101}
    assert {q["doc_id"] for q in got.where("removed").collect()} == {*range(1, 10), 101}
    cut = {q["doc_id"]: q["text"] for q in substring.without_repeats(d, got).collect()}
    assert len(cut[5]) < len(rows[5][1]) - 200 and cut[20] == rows[20][1] and cut[102] is None
    assert substring.repeated_passages(empty).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        v = [int(c) for c in d][::-1]
        return 16 <= len(d) <= 19 and (sum(v[0::2]) + sum(sum(divmod(2 * a, 10)) for a in v[1::2])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii(spark, docs, empty):
    texts = ["a@b.c%x@y.z a@b.c@d.ee", "1.2.3.4.5.6.7.8.9 300.1.1.1 0255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 555-0100 +12 34", 'é4111111111111111é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "9" * 3000, "a." * 3000 + "@", "a@b.co 1.2.3.4 " * 150]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = pii.find(d)
    for r in found.collect():
        want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, r["text"] or "") if fits(k, m.group())]
        got = [(pii.NAMES[s["kind"]], s["start"], s["end"]) for s in r["spans"]]
        assert [g for g in got if g[0] in PLAIN] == want
        if r["doc_id"] == 104:
            assert any(g[0] == "secret" for g in got)
    red = {r["doc_id"]: r["text"] for r in pii.redacted(d).collect()}
    assert red[1] is None and "04dbebab" not in red[104] and red[103].startswith("[PHONE]") and red[107].startswith("[EMAIL] [IP] ")
    assert pii.find(empty).count() == 0 and pii.redacted(docs).columns == docs.columns


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    whole = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from causalnet.llm.shared import durable

        d = durable(stage(spark, d, SF), name)
        assert d.columns == whole and d.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert last.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
