"""Each operator on the edge table against a brute-force version, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
import xxhash  # noqa: E402

from millrace.llm import boost, components, media, packing, piece_codec, quality, repeats, run_length_index, shards, shared, simhash, token_files, toxicity  # noqa: E402

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LAST = 1 << 63


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def repeats_brute(rows):
    order = sorted(rows, key=lambda r: LAST if r[0] is None else r[0])
    first, out = {}, []
    for doc, text in order:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, LAST), LAST if doc is None else doc)
    for doc, text in order:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (LAST if doc is None else doc):
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(edge):
    assert Counter(tuple(r) for r in repeats.repeat_digests(edge).collect()) == repeats_brute(rows_of(edge))


def test_repeats_common_anchor(edge, monkeypatch):
    monkeypatch.setattr(repeats, "COMMON", 2)  # strings of every shared anchor dealt one by one
    assert Counter(tuple(r) for r in repeats.repeat_digests(edge).collect()) == repeats_brute(rows_of(edge))


def test_repeats_in_small_groups_windows_and_indexes(edge, monkeypatch):
    for name, value in (("GROUP_BYTES", 2000), ("WINDOW", 64), ("INDEX_BYTES", 500)):
        monkeypatch.setattr(repeats, name, value)
    small = edge.where("length(text) < 3000 or text is null")
    assert Counter(tuple(r) for r in repeats.repeat_digests(small).collect()) == repeats_brute(rows_of(small))


def test_repeats_come_from_the_index_alone(edge, monkeypatch):
    table = pa.table({"doc_id": [1, 2, 3, 3], "text": ["x" * 20 + "passage that two documents share, word for word, here" + t for t in ("", "a", "", "b")], "__g": [0] * 4})
    got = []
    for silent in (False, True):
        if silent:
            monkeypatch.setattr(repeats.RunLengthIndex, "matches", lambda self, *_: (np.zeros(0, np.int64),) * 3)
        shared = pa.Table.from_batches(list(repeats._share(repeats._send_anchors(2)(table).to_batches())))
        sent = repeats._send_segments(2)(table, shared)
        marks = pa.Table.from_batches(list(repeats._mark(sent.to_batches())), repeats._MARKS)
        got.append([0 if g is None else int(g.sum()) for (g,) in repeats._cut(lambda _, gone: (gone,))(table, marks)[1]])
    assert got == [[0, 73, 73, 73], [0, 0, 0, 0]]


def test_index_matches_of_foreign_patterns():
    rng = random.Random(3)
    for trial in range(60):
        letters = b"ab" if trial % 2 else b"abcdefgh "
        length = rng.choice((8, 11, 50))

        def draw(n):
            return bytes(rng.choice(letters) for _ in range(rng.randint(0, n)))

        base = [draw(90) for _ in range(rng.randint(0, 8))]
        texts = base + [b[: rng.randint(0, len(b))] + draw(40) for b in base]
        patterns = [*texts, *(rng.choice([*texts, b""])[rng.randint(0, 5) :] + draw(30) + rng.choice((b"", b"zz")) for _ in range(10))]
        owners = [rng.randint(0, 9) for _ in texts]
        first = {}
        for t, o in zip(texts, owners):
            for k in range(len(t) - length + 1):
                first[t[k : k + length]] = min(first.get(t[k : k + length], 99), o)
        want = sorted((i, k, first[p[k : k + length]]) for i, p in enumerate(patterns) for k in range(len(p) - length + 1) if p[k : k + length] in first)
        (data, lens), (more, sizes) = ((np.frombuffer(b"".join(x), np.uint8), np.array([len(t) for t in x], np.int64)) for x in (texts, patterns))
        index = run_length_index.RunLengthIndex(data, lens, np.array(owners, np.int64), length)
        assert sorted(zip(*(x.tolist() for x in index.matches(more, sizes)))) == want


def test_cut_repeats_keeps_columns_and_characters(edge):
    out = repeats.cut_repeats(edge)
    assert out.columns == edge.columns
    got = out.collect()
    assert len(got) == edge.count()
    whole = {r.doc_id: r.text for r in got if r.doc_id in (13, 14)}
    assert whole[14].endswith("ß") and set(whole[14]) <= {"é", "ß"}
    assert [r.text for r in got if r.doc_id == 0] == [None]


def test_token_files(spark, edge, tmp_path):
    path = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(edge, WORDS, path, end_id=2)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).collect()]
    tok = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text in rows_of(edge):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(doc, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == np.cumsum([0, *(r[2] for r in ordered)])[:-1].tolist()
    docs = [-1 if r[0] is None else r[0] for r in ordered]
    assert docs == sorted(docs)
    assert sum(p["ids"] for p in manifest) == sum(r[2] for r in got)


def test_token_files_32_bits(spark, edge, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    token_files.write_tokens(edge, WORDS, a, end_id=2)
    token_files.write_tokens(edge, WORDS, b, end_id=2, width=32)
    assert sorted(map(str, token_files.read_tokens(spark, a).collect())) == sorted(map(str, token_files.read_tokens(spark, b).collect()))


def test_piece_codec(edge):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for doc, text in rows_of(edge):
        ids = sp.encode(text or "")
        want[(doc, len(ids), ",".join(map(str, ids)), sp.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in piece_codec.encode_column(edge, PIECES).collect()) == want


def check_shards(got, rows, shards):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, groups, size = defaultdict(list), defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].append(r)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size) / shards
    for g in groups.values():  # a group is whole, or says that it alone is more than a shard's share
        assert {r.group_cut for r in g} == {len(g) > 1 and sum(r.size for r in g) > share}
        assert g[0].group_cut or len({r.shard for r in g}) == 1
    return size


def test_shards(edge):
    check_shards(shards.shard_by_bytes(edge, 5, rows_in_range=4).collect(), rows_of(edge), 5)


def test_shards_near_equal_with_a_hot_group(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "case when id % 3 = 0 then repeat('hot ', 50) when id % 10 = 1 then repeat(concat('warm', id % 70), 20) else concat('t', id, repeat(' w', cast(id % 97 as int))) end text")
    size = check_shards(shards.shard_by_bytes(docs, 12, rows_in_range=200).collect(), rows_of(docs), 12)
    assert max(size) < 1.05 * min(size)


def test_shard_levels():
    assert shards._levels([5.0, 1.0, 0.0], 3.0) == [0.0, 1.0, 2.0]
    assert shards._levels([0.0, 0.0], 4.0) == [2.0, 2.0]
    assert shards._levels([9.0, 1.0], 0.0) == [0.0, 0.0]


def simhash_brute(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(edge):
    rows = rows_of(edge)
    fps = {t: simhash_brute(t) for _, t in rows}
    nodes = sorted({d for d, _ in rows if d is not None})
    of = defaultdict(set)
    for d, t in rows:
        of[d].add(fps[t])
    label = {d: d for d in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and any((x ^ y).bit_count() <= 3 for x in of[a] for y in of[b]):
                    label[a], changed = label[b], True
    for r in simhash.near_copies(edge).collect():
        if r.doc_id is not None:
            assert r.component_id == label[r.doc_id]
            assert int(r.fingerprint, 16) in of[r.doc_id]


def test_simhash_of_a_document_with_several_texts(spark):
    texts = {"A": "alpha beta gamma delta epsilon", "B": "one two three four five six", "C": "quite another text of its own"}
    rows = [(3, "A"), (7, "A"), (7, "B"), (9, "B"), (12, "C"), (None, "B")]
    got = simhash.near_copies(spark.createDataFrame([(d, texts[t]) for d, t in rows], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(3, 3), (7, 3), (7, 3), (9, 3), (12, 12), (None, 3)])


def test_components_of_hubs_paths_and_loops(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5000), (6001, 6000), (6000, 6001), (None, 3), (7, None)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + i: 1000 for i in range(151)}, 6000: 6000, 6001: 6000}
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1).collect()


def test_simhash_links_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12, 4)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(np.bitwise_xor.reduce(flips[:, :, :k], axis=2).ravel() ^ np.repeat(base, 12) for k in (1, 2, 3, 4))]))
    node = np.arange(len(fps)) * 3
    entries = [np.concatenate(x) for x in zip(*simhash._entries(fps, node))]
    edges = [simhash.links_in_bucket(*[e[simhash._mix(entries[0]) % np.uint64(3) == k] for e in entries]) for k in range(3)]

    def roots(pairs):
        up = {int(n): int(n) for n in node}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(int(n)) for n in node]

    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3) * 3
    assert roots([(int(a), int(b)) for x, y in edges for a, b in zip(x, y)]) == roots(near.tolist())


def test_media(spark, edge, tmp_path):
    path = f"file://{tmp_path}/m"
    media.write_archives(edge, path, roll=3000)
    stored = media.read_archives(spark, path, range_bytes=2000)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_features(stored).collect())
    want = Counter()
    for doc, text in rows_of(edge):
        b = (text or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(doc, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert got == want


def test_media_member_is_retried_alone(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "part-000000-0000.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k:09d}_{k}.png", media.encode_png(media.payload_of(b"text %d" % k)))
    reader = media.ArchiveReader(f"file://{tmp_path}", 1 << 20, 3)
    failures = [OSError("lost"), zipfile.BadZipFile("damaged")]
    plain = zipfile.ZipFile.read

    class Flaky(zipfile.ZipFile):
        def read(self, info, *a):
            if info.filename.endswith("_1.png") and failures:
                raise failures.pop()
            return plain(self, info, *a)

    opened = reader._open
    reader._open = lambda name: (z := opened(name), setattr(z, "__class__", Flaky))[0]
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) == 3 and not failures


def test_packing(edge):
    tok = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text in rows_of(edge):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[(doc, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    got = packing.pack(edge, WORDS).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 4096
    assert len(used) == -(-sum(r.length for r in got) // 4096)


def test_evolve_finds_what_best_fit_misses():
    sizes = [6, 6, 5, 5, 5, 4, 4, 3, 3, 3, 2, 2, 2] * 6
    packed = packing.evolve(sizes, 10, 1, [], 200)
    assert sorted(i for b in packed.bins for i in b) == list(range(len(sizes)))
    assert max(packed.fill) <= 10 and len(packed.bins) == sum(sizes) // 10


def test_toxicity(edge, labels):
    got = toxicity.toxicity_scores(edge, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows_of(edge))
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_without_labels(edge, labels):
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(edge, labels.limit(0)).collect()}
    assert got[16] > 0.7 and got[1] == 0


def test_toxicity_disguises_and_nearness():
    table = toxicity._table({})
    x = toxicity.text_features([b"you are an 1d10t and st.u.pid", b"quite calm words here", b"IDIOT", b""], table)
    assert x[0, 16] == 2 and x[0, 14] > 0 and x[1, 15] == x[1, 16] == 0 and x[2, 15] == 1 and not x[3].any()


def plain_features(text):
    """The dense features of a text without a lexicon, word by word."""
    words = [w.decode() for w in text.encode().split()]
    insult, hidden, you, caps, masked = [], [], [], [], []
    for w in words:
        low = re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
        clear = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}.get(c, c) for c in w)
        clear = re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W_]+", "", clear)).lower()
        insult.append(low in toxicity.INSULTS)
        hidden.append(low not in toxicity.INSULTS and clear in toxicity.INSULTS)
        you.append(low in toxicity.SECOND)
        letters = [c for c in w if c.isalpha()]
        caps.append(len(letters) > 1 and all(c.isupper() for c in letters))
        inner = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        masked.append(bool(letters) and (not inner.isalpha() or re.search(r"(.)\1{2,}", low) is not None))
    out, n, every = np.zeros(toxicity.FEATURES), len(words), "".join(words)
    if not n:
        return out
    digits = sum(c.isdigit() for c in every)
    out[[0, 1, 4, 5, 6]] = [sum(x) / n for x in (insult, hidden, you, caps, masked)]
    out[7:12] = [x / len(every) for x in (sum(c.isupper() for c in every), len(every) - sum(c.isalpha() for c in every) - digits, every.count("!"), every.count("?"), digits)]
    hits = [k for k in range(n) if insult[k] or hidden[k]]
    gaps = [abs(k - j) for k in hits for j in range(n) if you[j] and abs(k - j) <= 8]
    out[14] = 1 / (1 + min(gaps)) if gaps else 0
    out[[15, 16, 19]] = sum(insult), sum(hidden), np.log1p(n)
    return out


def test_toxicity_features_are_those_of_each_word(edge):
    texts = [t or "" for _, t in rows_of(edge)] + ["you IDIOT!! y0u st*pid", "1d10t ... you, sir", "calm one two three four five six seven eight you fool", "LOOSERRR l o s e r", "you " * 9 + "fool"]
    texts = [t for t in texts if len(t) < 20_000]
    got = toxicity.text_features([t.encode() for t in texts], toxicity._table({}))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-6)


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(5)
    margin = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-3 * margin))).astype(float)
    fit = boost.Isotonic().fit(margin, y)
    blocks = np.array([max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)])  # max-min formula
    assert np.allclose(fit.p, blocks[np.concatenate([[True], np.diff(blocks) > 1e-12])])
    scores = fit.apply(np.linspace(-4, 4, 200))
    assert (np.diff(scores) > 0).all() and scores.min() >= 0 and scores.max() <= 1


def test_held_out_labels_change_no_score(spark, edge, labels):
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.training_split(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity_scores(edge, x).collect()) for x in (labels, other))
    assert a == b


def test_islands_migrate_and_beat_best_fit(spark):
    sizes = [6, 6, 5, 5, 5, 4, 4, 3, 3, 3, 2, 2, 2] * 12
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    plain = packing.Packing(sizes, 10).best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    assert len(plain.bins) > sum(sizes) // 10  # so that crossover and migration run
    got = packing.solve(items, 1, 10, islands=3, epochs=3, generations=60).collect()
    assert sorted((r["item"], r["size"]) for r in got) == list(enumerate(sizes))
    fills = defaultdict(int)
    for r in got:
        fills[r["bin"]] += r["size"]
    assert max(fills.values()) <= 10 and len(fills) < len(plain.bins) and all(fills[r["bin"]] == r["fill"] for r in got)


def test_crossover_injects_whole_bins_and_repeats_nothing():
    rng = random.Random(6)
    sizes = [rng.randint(1, 9) for _ in range(60)]
    a = packing.Packing(sizes, 10).best_fit(rng.sample(range(60), 60))
    b = packing.Packing(sizes, 10).best_fit(rng.sample(range(60), 60))
    for _ in range(20):
        child = a.crossed(b, rng)
        assert sorted(i for x in child.bins for i in x) == list(range(60)) and max(child.fill) <= 10
        assert child.fill == [sum(sizes[i] for i in x) for x in child.bins]
        assert any(set(x) in [set(y) for y in b.bins] for x in child.bins)


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = [(r.score, r.predicted, r.toxic) for r in toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    toxic, clean = [r for r in got if r[2]], [r for r in got if not r[2]]
    assert sum(a[0] > b[0] for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.9
    assert sum(r[1] for r in clean) <= 0.02 * len(clean)


def test_quality(edge, labels):
    got = quality.quality_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.quality_score <= 1 for r in got)


def test_quality_keeps_every_column_but_its_own(edge, labels):
    from pyspark.sql import functions as F

    out = quality.with_quality(edge, labels, F.col("source"), F.col("lang"))
    assert set(edge.columns) <= set(out.columns) and out.count() == edge.count()


def test_quality_shrinks_sparse_sites(spark):
    model = quality.Model(0.5)
    rows = spark.createDataFrame([("big", "a", 0.9)] * 400 + [("small", "a", 0.1)] + [("other", "a", 0.5)] * 400, "host string, path string, evidence double")
    s = {r.host: r for r in quality.sites(rows, model).collect()}
    assert s["big"].host_rate > 0.85 and s["small"].host_rate > 0.4


def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F

    out = quality.with_quality(docs, labels, F.col("source"), F.col("lang"), toxicity.training_split())
    held = out.join(labels.select("doc_id", "quality"), "doc_id").where(~toxicity.training_split()).select("quality", "quality_score").collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("apply", ["repeats", "cut", "tokens", "pieces", "shards", "simhash", "media", "packing", "toxicity", "quality"])
def test_empty_table(spark, empty, labels, tmp_path, apply):
    path = f"file://{tmp_path}/e"
    out = {
        "repeats": lambda: repeats.repeat_digests(empty),
        "cut": lambda: repeats.cut_repeats(empty),
        "tokens": lambda: token_files.read_tokens(spark, path, token_files.write_tokens(empty, WORDS, path, 2)),
        "pieces": lambda: piece_codec.encode_digests(empty, PIECES),
        "shards": lambda: shards.shard_by_bytes(empty),
        "simhash": lambda: simhash.near_copies(empty),
        "media": lambda: (media.write_archives(empty, path), media.media_features(media.read_archives(spark, path)))[1],
        "packing": lambda: packing.pack(empty, WORDS),
        "toxicity": lambda: toxicity.toxicity_scores(empty, labels),
        "quality": lambda: quality.quality_scores(empty, labels),
    }[apply]()
    assert out.collect() == [] and len(out.columns) > 1


class _Session:
    def __init__(self, folder, master):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, type("Context", (), {"master": master, "applicationId": "a"})


def test_shared_folder_is_read_from_the_session():
    assert shared.shared_dir(_Session("hdfs://store/x", "yarn")) == "hdfs://store/x"
    assert shared.shared_dir(_Session("/mnt/x", "yarn")) == "file:///mnt/x"
    assert shared.shared_dir(_Session(None, "local[4]")) == shared.shared_dir(_Session(None, "local[4]"))
    with pytest.raises(ValueError):
        shared.shared_dir(_Session(None, "yarn"))
