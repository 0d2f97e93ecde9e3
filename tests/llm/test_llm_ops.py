"""The ten operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import chat, langid, media, mixing, packing, pii, quality, queries, sharding, simhash, topk
from larkspur.session import own_path, stored, table, unused

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, d int"
ODD = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "a", 0, None, None),
    (3, "same words here again", "en", "a", 21, "y", 2),
    (4, "same words here again", "en", None, 21, "y", 2),
    (4, "same words here again", "en", None, 21, "y", 2),
    (None, "same Words here again", "fr", "b", 21, "y", 2),
    (5, "long " * 30000 + "mail a.b@c.example.org or +49 30 1234567", "de", "a", 150000, "z", 3),
    (6, "<|user|>\\ 1.2.3.4 </s> \x00 \U0001f926 é", "en", "b", 30, "z", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


def brute_topk(rows, k):
    v = {i: np.floor(64 * np.array(x, dtype=float)).astype(int) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    n = max((len(x) for x in v.values()), default=0)
    v = {i: np.pad(x, (0, n - len(x))) for i, x in v.items()}
    out = set()
    for q in v:
        if q % 20 == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("sample", [8, 4096])
def test_topk_is_exact(spark, sample):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 700)]  # one vector many times
    rows += [(700, None), (720, [float("nan")] * 6), (740, [None, 1.0]), (760, []), (780, [1.0, 2.0]), (None, [1.0] * 6), (800, [float("inf")])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=7, sample_rows=sample, block_rows=50, query_rows=10, pivots=5)
    rows = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    assert {tuple(r) for r in got.collect()} == brute_topk(rows, 7)


def test_topk_few_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("id") % 20 == 0).count() == 0
    assert topk.top_k(one.limit(0), F.col("id") % 20 == 0).count() == 0


def test_media_tables_and_round_trip():
    assert media.TABLES["mulaw"][[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.TABLES["alaw"][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    payload = bytes(range(256)) * 2
    for codec in media.TAGS:
        kind, data = media.unwrap(media.wrap(payload, codec))
        assert kind == codec and media.payload_of(kind, data) == payload


def test_adpcm_matches_a_plain_decoder():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = media.decode_adpcm(blocks)
    for b, row in zip(blocks, got, strict=True):
        x, index, want = int(b[:2].view("<i2")[0]), int(b[2]), []
        want.append(x)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step, delta = int(media.STEPS[index]), int(media.STEPS[index]) >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    delta += part if code & bit else 0
                x = max(-32768, min(32767, x - delta if code & 8 else x + delta))
                index = max(0, min(88, index + int(media.CHANGES[code & 7])))
                want.append(x)
        assert row.tolist() == want


def plain_wide(codec, payload):
    """16 kHz samples by plain Python: one byte or nibble at a time, then the floor of each two neighbours' mean between them."""
    if codec == "adpcm":
        x = []
        for at in range(0, len(payload), 64):
            head, index = 0, 0
            x.append(head)
            for byte in payload[at : at + 64]:
                for code in (byte & 15, byte >> 4):
                    step = int(media.STEPS[index])
                    delta = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
                    head = max(-32768, min(32767, head - delta if code & 8 else head + delta))
                    index = max(0, min(88, index + int(media.CHANGES[code & 7])))
                    x.append(head)
    else:
        x = [int(media.TABLES[codec][b]) for b in payload]
    return x, [v for a, b in zip(x, x[1:] + x[-1:], strict=True) for v in (a, (a + b) // 2)]


def test_media_digests(spark, odd, none, tmp_path):
    stored = media.store_audio(odd, path=str(tmp_path / "media"))
    files = {r.media: r for r in stored.collect()}
    assert spark.read.parquet(str(tmp_path / "media")).count() == len(ODD)
    rows = media.expand(stored).collect()
    assert len(rows) == len(ODD) and media.expand(media.store_audio(none)).count() == 0
    raw = Counter((t or "").encode() for _, t, *_ in ODD)
    by_digest = {hashlib.sha256(m).hexdigest(): r for m, r in files.items()}
    seen = Counter()
    for r in rows:
        own = by_digest[r.media_sha256]
        kind, data = media.unwrap(own.media)
        p = media.payload_of(kind, data)
        text = p[: r.n_bytes]
        seen[text] += 1
        assert p == text + bytes(-len(text) % 64 or (0 if text else 64)) and r.media_bytes == len(own.media)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        x, wide = plain_wide(kind, p)
        raw_wide = np.array(wide, dtype="<i2").tobytes()
        assert r.pcm == raw_wide
        turns = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        assert r.feature == f"{kind}:{len(x)}:{max(map(abs, x))}:{sum(map(abs, x)) // len(x)}:{turns}:{zlib.crc32(raw_wide):08x}"
    assert seen == raw


def test_media_clashing_columns(odd):
    clash = odd.selectExpr("*", "doc_id AS media", "doc_id AS pcm", "doc_id AS codec")
    assert media.expand(media.store_audio(clash)).count() == len(ODD)


def brute_simhash(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fps = {r.doc_id: brute_simhash(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("heavy", [65536, 40])
def test_trie_join_finds_every_link(spark, heavy):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).tolist()
    ball = [base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))]
    values = sorted({*base, *ball, 0, *(b ^ 1 ^ (1 << 62) for b in base[1:20])})
    fps = dict(enumerate(values))
    rows = spark.createDataFrame([(x,) for x in values], "fp long")
    edges = simhash.links(rows, len(values), 2, heavy)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for i, x in fps.items():
        groups.setdefault(roots.get(x, x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_odd_rows(odd, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3)} <= got
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(odd).collect()) == [1, 3, 5, 6]


def test_keep_one_of_each_component(spark):
    """Components that share their smallest id keep a row each; copies do not, with an id or without."""
    a, b, c, d = "red cars drive along the old road", "seven ships sail over a calm sea", "nobody knows how this story ends", "bread is baked before the sun rises"
    rows = [(1, a), (1, b), (1, b), (2, b), (None, a), (None, c), (None, c), (None, d), (3, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (None, c), (None, d), (3, "")], key=str)


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels), keep=["doc_id"])
    rows = scored.join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.3) == r.predicted and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    good = [r.predicted for r in held if r.quality == 1]
    assert np.mean(good) > 0.97


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (6, 0), (5, None), (4, 1)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, labels)).count() == len(ODD)
    empty = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.score(none, empty).count() == 0


def test_quality_clashing_columns(odd):
    model = quality.Ranker(np.zeros((0, 1)), np.zeros(0), 0.3)
    assert quality.score(odd, model).columns == [*odd.drop("score").columns, "score", "predicted"]
    kept = quality.score(odd, model, own=("_score", "_kept"))
    assert {r.score for r in kept.collect()} == {r[5] for r in ODD}


def test_clashing_columns_stay(spark, odd):
    """Whatever the operators call their own columns, a user's column of that name comes out as it went in."""
    names = "base added ordered new key mark at one _fp _h fp size turns _size _key _twin _runs runs n _kept _score kept".split()
    clash = odd.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    labels = spark.createDataFrame([(1, 0), (3, 1), (6, 0), (4, 1)], "doc_id long, quality int")
    for out in (pii.redact(clash), simhash.keep_one(clash), mixing.Mix(clash).texts(clash), corpus_stage(spark, clash, labels)):
        assert out.columns == clash.columns
        assert {tuple(r) for r in out.select(*names).collect()} <= {tuple(names)}


def corpus_stage(spark, docs, labels):
    score, kept = unused(docs.columns, "score", "kept")
    return quality.score(docs, quality.train(docs, labels), own=(score, kept)).select(docs.columns)


def test_mix_gives_repeated_rows_their_own_shares(spark):
    """Rows alike in id, text and source, with nulls among them: each is taken at most twice, and the words come out whole."""
    rows = [(i, f"w{i} " * 40, "a") for i in range(5)] + [(9, "x " * 100, "b")] * 7 + [(None, "y " * 30, None)] * 4 + [(8, "", "b")] * 2
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    mix = mixing.Mix(docs, block_words=16)
    want = Counter()
    for r in mix.taken().collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mix.texts(docs).collect():
        got[r.doc_id] += len(r.text.split())
    assert +got == +want


def plain_mix(rows):
    """Sizes and targets by plain Python."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    have = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, aim, left = 1.5 * sum(have.values()), {}, set(names)
    while left:
        unit = total / sum(weight[s] for s in left)
        full = {s for s in left if unit * weight[s] > 2 * have[s]}
        if not full:
            aim |= {s: unit * weight[s] for s in left}
            break
        aim |= {s: 2.0 * have[s] for s in full}
        total -= sum(aim[s] for s in full)
        left -= full
    return size, have, aim


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_mix_against_plain_python(spark, odd, name):
    docs = odd if name == "odd" else table(spark, "/root/testdata/sf0.001", name)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, have, aim = plain_mix(rows)
    got = mixing.Mix(docs).taken().collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter((r[0], n, have[r[2]], round(aim[r[2]], 6)) for r, n in zip(rows, size, strict=True))


def test_water_filling():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([20, 295 * 2 / 3, 295 / 3])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_permutations_and_deal():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    slots = np.array([100, 7, 0, 33])
    counts = mixing.deal(slots, 16, 3)
    assert (counts.sum(0) == slots).all() and counts.min() >= 0 and np.ptp(counts.sum(1)) <= 1


def test_mix_comes_near_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.Mix(docs, bucket_docs=20).taken().select("doc_id", "source", "size", "taken", "target", "source_size").collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows) and len(rows) == docs.count()
    sums, sizes = Counter(), Counter()
    for r in rows:
        sums[r.source] += r.taken
        sizes[r.source] += r["size"]
    for r in rows:
        assert sizes[r.source] == r.source_size and abs(sums[r.source] - r.target) <= 0.05 * r.target + 512
    again = mixing.Mix(docs.repartition(7), bucket_docs=20).taken()
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in rows}


def test_mix_texts(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    mix = mixing.Mix(docs)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    words = Counter()
    for r in mix.texts(docs).collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert mixing.Mix(none).taken().count() == 0 and mixing.Mix(none).texts(none).count() == 0
    assert mixing.Mix(odd).taken().count() == len(ODD) and mixing.Mix(odd).texts(odd).columns == odd.columns


def test_blocks_are_joined_by_slot(spark):
    mix = mixing.Mix(table(spark, "/root/testdata/sf0.001", "documents"), block_words=64, shards=4)
    slots = mix.slots.collect()
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values()) and len(by_shard) == 4
    assert max(Counter((r.sid, r.block) for r in slots).values()) <= 2


def test_langid_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs, langid.train(docs)).join(docs, "doc_id").select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    scores, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, moves, _ = langid.forward_backward(scores, np.array([4, 3]), trans, start)
    total = np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        want, z, own = np.zeros((b - a, 3)), 0.0, np.zeros((3, 3))
        for path in product(range(3), repeat=b - a):
            w = np.exp(start[path[0]] + sum(scores[a + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:], strict=False)))
            z += w
            for i, y in enumerate(path):
                want[i, y] += w
            for x, y in zip(path, path[1:], strict=False):
                own[x, y] += w
        total += own / z
        assert np.allclose(p[a:b], want / z)
    assert np.allclose(moves, total)


def test_langid_odd_rows(odd, none):
    model = langid.train(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == "und" and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


def test_code_switched_words_keep_their_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    texts = {r.lang: r.text for r in docs.filter("n_chars between 400 and 900").collect()}
    words = {k: langid.words_of(v)[:30] for k, v in texts.items()}
    joined = [w for k in sorted(words) for w in words[k]]
    gold = [model.langs.index(k) for k in sorted(words) for _ in words[k]]
    p, _, _ = langid.forward_backward(langid.emissions(joined, model.weights), np.array([len(joined)]), model.trans, model.start)
    assert np.mean(p.argmax(1) == gold) > 0.9


def test_chat_trees(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b</s>", 2.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 99, "user", "orphan", 0.0), ("u", 1, 2, "user", "x", 0.0), ("u", 2, 1, "user", "y", 0.0)]
    got = chat.conversations(spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double"), None)
    out = {r.leaf: (r.formatted, r["rank"]) for r in got.collect()}
    assert out == {2: ("<|user|>hi</s><|assistant|>a</s>", 2), 4: ("<|user|>hi</s><|assistant|>b<\\/s></s><|user|></s>", 1), 5: ("<|user|>orphan</s>", 3)}


def test_chat_links_without_texts(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, None, "b"), (None, 1, "user", ""), (2, 5, "user", "c")]
    for some in (rows, []):
        table = spark.createDataFrame(some, "conv_id long, turn long, role string, text string")
        rowwise, counted = (sorted(map(tuple, d.select("tree", "id", "parent").collect()), key=str) for d in (chat.chain(table), chat.chain_links(table)))
        assert rowwise == counted and len(counted) == len(some)
        told = [chat.conversations(chat.chain(table), links=x).select("tree", "formatted", "loss_mask").collect() for x in (None, chat.chain_links(table))]
        assert sorted(told[0]) == sorted(told[1])


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\|x|\\> <|>", "", None, "[\\\\INST] </s", "|", "> a", "\U0001f926<", "a\nb"]
    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(7, 3, "a|", "t"), (None, 1, None, "lone")]
    told = chat.conversations(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree: r for r in told.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted").collect()}
    want = sorted(((t, r or "", x or "") for _, t, r, x in rows[:-1]), key=lambda z: z)
    assert [(t.role, t.text) for t in got["7"].turns] == [(r, x) for _, r, x in want]
    assert got["7"].loss == "".join(x for _, r, x in want if r == "assistant")
    assert [(t.role, t.text) for t in got[""].turns] == [("", "lone")]


def test_long_threads_take_few_joins(spark):
    rows = spark.range(700).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    got = chat.conversations(chat.chain(rows)).select(F.size(chat.read_turns(F.col("formatted"))).alias("n")).collect()
    assert [r.n for r in got] == [700]


def test_shards_are_even_and_gapless(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got, slot_map = sharding.shard(docs, 16)
    rows = got.collect()
    sums, slots = Counter(), {}
    for r in rows:
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())
    before = slot_map.current.copy()
    load = np.bincount([r.virtual_slot for r in rows], [r["size"] for r in rows], minlength=sharding.SLOTS).astype(np.int64)
    slot_map.grow(16, load)
    moved = before != slot_map.current
    assert moved.any() and (slot_map.current[moved] == 16).all()
    grown = sharding.shard(docs, slot_map=slot_map)[0].collect()
    was = {r.doc_id: r.shard for r in rows}
    assert {r.shard for r in grown if r.shard != was[r.doc_id]} == {16}
    slots = {}
    for r in grown:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(none, 16)[0].count() == 0


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_shard_columns_by_plain_python(spark, odd, name):
    docs = odd if name == "odd" else table(spark, "/root/testdata/sf0.001", name)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    rows = sharding.shard(docs, 3)[0].collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_shards_stay_even_where_an_id_is_hot(spark):
    """A third of all rows without an id, and one row many times."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "repeat('t', cast(id % 50 AS int)) || id AS text")
    rows = rows.unionByName(spark.range(300).selectExpr("7L AS doc_id", "'same' AS text"))
    got = sharding.shard(rows, 4)[0].collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert len(got) == 6300 and max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))


def test_slot_map_is_stored_by_version(spark, tmp_path):
    m = sharding.SlotMap(4, 64)
    m.rebalance(np.arange(64), 4)
    m.save(spark, str(tmp_path / "map"))
    back = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert len(back.versions) == 2 and all((a == b).all() for a, b in zip(m.versions, back.versions, strict=True))
    back.grow(4, np.arange(64))
    before = {p.name for p in (tmp_path / "map").glob("*.parquet")}
    back.save(spark, str(tmp_path / "map"))
    after = {p.name for p in (tmp_path / "map").glob("*.parquet")}
    assert before < after and len(sharding.SlotMap.load(spark, str(tmp_path / "map")).versions) == 3
    back.save(spark, str(tmp_path / "map"))
    assert {p.name for p in (tmp_path / "map").glob("*.parquet")} == after


def starts(n):
    at = 0
    for length in packing.lengths(n):
        yield at, length
        at += length


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    docs = odd.unionByName(table(spark, "/root/testdata/sf0.001", "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text"), allowMissingColumns=True)
    rows = packing.pack(docs, path, with_ids=True, group_rows=100).collect()
    by_doc, want = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids)
    for d in docs.collect():
        want.setdefault(d.doc_id, []).append(np.array([*model.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    for key, texts in want.items():
        own = sorted(by_doc[key], key=lambda r: r.start)  # rows that repeat: each piece as often as there are rows
        assert Counter((r.start, r.ids, r.doc_tokens) for r in own) == Counter((at, ids[4 * at : 4 * (at + n)], len(ids) // 4) for ids in texts for at, n in starts(len(ids) // 4))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True) and packing.pack(none, path).count() == 0


def test_packing_added_tokens(spark):
    """A text that holds an added token gets that token's id, as plain `encode` gives it."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["one<|endoftext|>two", "<|endoftext|>", " <|endoftext|> <|endoftext", "plain words"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).orderBy("doc_id", "start").collect()
    for i, text in enumerate(texts):
        ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
        assert b"".join(r.ids for r in rows if r.doc_id == i) == np.array(ids, dtype="<u4").tobytes()
    assert 50256 in np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == 1), dtype="<u4")


def brute_pii(text):
    import re

    text, out = text or "", []

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


NASTY = [
    None, "", "a@b.c@d.e.f_d@e.f a@b x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3 9999999999999999999999.1.1.1", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1 5",
    "+1 (736) 555-2678 ve +12 +123456789012345678 +1+2345678901", "\U0001f926 é a@b.co \U0001f926 +49 30 123456", "1" * 20000, "a" * 20000 + "@", "x" * 500 + "@" + "a." * 3000, "@" * 3000, "+1" + " " * 5000, "1 " * 8000,
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000x DE89370400440532013000, card 378282246310005", "1.1.1.1" * 500,
]


def test_pii_against_plain_patterns(spark, sf_dir):
    docs = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    docs = docs.unionByName(table(spark, sf_dir, "documents").selectExpr("doc_id + 1000 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.spans(docs).select("doc_id", pii.listing(F.col("base")).alias("base"), pii.listing(F.col("added")).alias("added")).collect()}
    assert {k: r.base for k, r in got.items()} == {k: brute_pii(t) for k, t in texts.items()}
    kinds = [x.split(":")[0] for x in got[13].added.split(",")]
    assert kinds == ["iban", "iban", "pan"] and sum(bool(r.base) for r in got.values()) > 8


def test_ibans_before_words(spark):
    """Compact and grouped, of each length from 15 to 32, with words, digits or another IBAN behind them."""
    known = "NO9386011117947 BE68539007547034 NL91ABNA0417164300 AT611904300234573201 LT121000011101001000 LU280019400644750000 CH9300762011623852957 DE89370400440532013000 ES9121000418450200051332 SE4550000000058398257466 CZ6508000000192000145399 RO49AAAA1B31007593840000 FR1420041010050500013M02606 PL61109010140000071219812874 HU42117730161111101800000000 LC55HEMM000100010012001200023015".split()
    grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in known]
    rows = [(f"to {x}{after}", f"iban:3:{3 + len(x)}") for x in known + grouped for after in (" Please", " BIC X", " PLEASE PAY", " 2024", " 2 B", ", x", "")]
    rows += [(f"{a} {b} Now", f"iban:0:{len(a)},iban:{len(a) + 1}:{len(a) + 1 + len(b)}") for some in (known, grouped) for a, b in zip(some, some[1:])]
    rows += [(f"REF12AB34 {x} Now", f"iban:10:{10 + len(x)}") for x in grouped]
    rows += [(x, "") for x in ("ES9121000418450200051333 Please", "xES9121000418450200051332 P", "ES9121000418450200051332P", "AT61 1904", "AT61")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in pii.spans(docs).select("doc_id", pii.listing(F.filter("added", lambda s: s["kind"] == "iban")).alias("found")).collect()}
    assert [(t, got[i]) for i, (t, want) in enumerate(rows) if got[i] != want] == []


def test_redaction(spark, none):
    docs = spark.createDataFrame([(1, "a a@b.co, +49 30 1234567.", 25), (2, None, None), (3, "clean", 5), (4, "4111 1111 1111 1111", 19)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "a <EMAIL>, <PHONE>.", 19), (2, None, None), (3, "clean", 5), (4, "<CARD>", 6)]
    assert pii.redact(none).count() == 0


def test_mod97_and_luhn(spark):
    got = spark.sql("SELECT 'GB82WEST12345698765432' a, 'GB82WEST12345698765433' b, '4111111111111111' c, '4111111111111112' d").select(pii.mod97(F.col("a")), pii.mod97(F.col("b")), pii.luhn(F.col("c")), pii.luhn(F.col("d"))).first()
    assert list(got) == [True, False, True, False]


def test_queries_have_the_contract_columns(spark, sf_dir):
    want = {
        "op1_topk": "query_id rank vec_id score", "op2_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op3_simhash": "doc_id fingerprint component_id",
        "op4_quality": "doc_id held_out score predicted", "op5_mixing": "doc_id size source_size target taken", "op6_langid": "doc_id held_out lang_pred score", "op7_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.queries()[name](spark, sf_dir).columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = db.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and Counter(map(tuple, got[columns].astype(str).values)) == Counter(map(tuple, want[columns].astype(str).values))


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (6, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.select("doc_id", "text", "lang", "source", "n_chars", "d", F.lit("x").alias("kept")).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and (rows or name == "none")


def written(spark, df):
    return stored(df, own_path(spark, "test"))


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    kept = written(spark, corpus_pipeline.keep_quality(spark, docs, sf_dir))
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    good = {r.doc_id for r in docs.collect() if model.score(quality.features(r.text)[None].astype(float))[0] >= 0.3}
    assert {r.doc_id for r in kept.collect()} == good
    one = written(spark, corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir))
    classes = brute_components({r.doc_id: brute_simhash(r.text) for r in kept.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values())) and one.columns == docs.columns
    clean = written(spark, corpus_pipeline.redact_personal_data(spark, one, sf_dir))
    assert clean.count() == one.count() and not any(brute_pii(r.text) for r in clean.collect())
    mixed = written(spark, corpus_pipeline.mix_sources(spark, clean, sf_dir))
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf_dir)
    tokens = packing.pieces(mixed, queries.tokenizer_path()).agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == tokens
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
