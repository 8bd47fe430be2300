"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from verisift.llm import language, licenses, matroska, mixing, neardup, onebit, pages, queries, substrings, token_store, unigram

DOC = "doc_id long, text string"
#: Null, empty, blank, one letter, symbols, NUL, other scripts, a very long text, repeated rows, a shared id, no id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "!!! 123 ___"), (6, "x\x00y"), (7, "日本語 テキスト 😀 naïve"), (8, "word " * 30_000), (9, "same row"), (9, "same row"), (10, "first of an id"), (10, "second of an id"), (None, "no id"), (None, None), (11, "tail  \n spaces   ")]
WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def frame(spark, rows, extra=True):
    """Rows with extra columns whose names clash with those that operators make."""
    df = spark.createDataFrame(rows, DOC)
    if extra:
        df = df.withColumns({"n": F.lit(1), "g": F.lit(2), "key": F.lit("k"), "text_a": F.lit("x"), "rep": F.lit(0), "bucket": F.lit(5), "u": F.lit(7), "n_removed": F.lit(3), "replica": F.lit(1), "media": F.lit(b"m"), "n_words": F.lit(9)})
    return df


def random_docs(n, seed, vocabulary=200, most=120):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [(k, r.choice([" ", "\n", "  "]).join(r.choice(names) for _ in range(r.randint(0, most)))) for k in range(n)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(name, spark, duck, sf_dir):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).fetchdf())


# --- 1: Matroska -----------------------------------------------------------


@pytest.mark.parametrize("lacing", range(4))
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 64 * 32, 64 * 33, 64 * 32 * 64 + 1])
def test_matroska_round_trip(lacing, size):
    payload = matroska.padded(bytes(random.Random(size).randbytes(size)))
    data = matroska.mux(payload, lacing)
    found = matroska.parse(data)
    assert matroska.payload_of(data, found) == payload and len(payload) % 64 == 0 and payload
    assert [p[3] for p in found.packets] == [64] * (len(payload) // 64)
    assert [p[1] for p in found.packets] == [8_000_000 * k for k in range(len(found.packets))]
    assert [at for _, _, at in found.cues] == found.clusters and found.tracks[1].codec == "A_PCM/INT/LIT"


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING])
def test_uneven_laces(lacing):
    frames = [bytes([k]) * n for k, n in enumerate((1, 255, 256, 700, 3, 0, 20_000, 5))]
    laced = matroska.lace(frames, lacing)
    sizes, at = matroska.frame_sizes(laced, 0, len(laced), lacing)
    assert sizes == [len(f) for f in frames] and laced[at:] == b"".join(frames)


def test_unknown_sizes_block_groups_and_damage():
    block = matroska.vint(1) + (5).to_bytes(2, "big") + b"\x00" + b"frame"
    cluster = lambda t, body: (0x1F43B675).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.number(matroska.TIMESTAMP, t) + body
    head = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm"))
    body = cluster(10, matroska.element(matroska.SIMPLE_BLOCK, block)) + cluster(20, matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.number(matroska.BLOCK_DURATION, 3)))
    data = head + (0x18538067).to_bytes(4, "big") + b"\xff" + body
    found = matroska.parse(data)
    assert [(p[1], data[p[2] : p[2] + p[3]], p[4]) for p in found.packets] == [(15_000_000, b"frame", 0), (25_000_000, b"frame", 1)]
    with pytest.raises(matroska.MatroskaError):
        matroska.parse(data[:-3])
    with pytest.raises(matroska.MatroskaError):
        matroska.parse(b"\x00\x01")


def test_any_damage_is_a_matroska_error():
    r = random.Random(4)
    files = [matroska.mux(matroska.padded(r.randbytes(64 * 70)), lacing) for lacing in range(4)]
    head, track = files[0][: files[0].index(b"\x18\x53\x80\x67")], matroska.vint(1)
    block = lambda body: head + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, body)))
    odd = [block(track), block(b""), block(track + b"\0\0\x82\x05\xff\xff"), block(track + b"\0\0\x86\x05\x00"), block(track + b"\0\0\x86"), block(track + b"\0\0\x86\x02\xff\x80"), head + matroska.element(matroska.SEGMENT, matroska.element(matroska.SIMPLE_BLOCK, track + b"\0\0\0x")), head + matroska.element(matroska.SEGMENT, matroska.element(matroska.INFO, matroska.element(matroska.DURATION, b"abc")))]
    for data in odd:
        with pytest.raises(matroska.MatroskaError):
            matroska.parse(data)
    for k in range(3000):
        data = bytearray(files[k % 4])
        for _ in range(r.randint(1, 4)):
            data[r.randrange(min(len(data), 400) if k % 3 else len(data))] = r.randrange(256)
        data = bytes(data[: r.randrange(len(data))] if k % 5 == 0 else data)
        try:
            found = matroska.parse(data)
        except matroska.MatroskaError:
            continue
        assert all(0 <= p[2] <= p[2] + p[3] <= len(data) for p in found.packets)
        matroska.feature(matroska.payload_of(data, found), found)


def test_damaged_and_null_files_keep_their_rows(spark):
    good = matroska.mux(matroska.padded(b"text"))
    media = spark.createDataFrame([(1, 4, good), (2, 4, good[:-9]), (3, 0, None), (4, 2, b"")], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in matroska.features(media).collect()}
    assert rows[1].payload_bytes == 64 and rows[2].feature.startswith("damaged: ") and rows[2].payload_sha256 is None and rows[2].media_bytes == len(good) - 9
    assert rows[3].feature is None and rows[3].media_bytes is None and rows[4].feature == "damaged: no Matroska header"
    assert {r.doc_id for r in matroska.packet_rows(media).collect()} == {1}


def test_matroska_operators_on_odd_rows(spark):
    media = matroska.store(frame(spark, ODD))
    rows = matroska.features(media).collect()
    want = sorted((i or -1, hashlib.sha256(matroska.padded((t or "").encode())).hexdigest(), zlib.crc32(matroska.padded((t or "").encode())[-64:]), len((t or "").encode())) for i, t in ODD)
    assert sorted((r.doc_id or -1, r.payload_sha256, r.tail_crc32, r.n_bytes) for r in rows) == want
    assert matroska.packet_rows(media.where("doc_id = 4")).count() == 1
    assert matroska.features(matroska.store(frame(spark, []))).count() == 0


# --- 2: near duplicates ----------------------------------------------------


def brute_groups(rows, width, percent):
    sets = []
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i)) for i, s in sets)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    r = random.Random(3)
    rows = [x for x in random_docs(60, 1)]
    bases = [t for _, t in rows if len(t.split()) > 60][:4]
    for b in bases:  # a group of copies edited lightly and heavily, and exact copies in other case
        rows += [(len(rows) + k, edited(b, r, r.randint(0, 9))) for k in range(25)] + [(1000 + len(rows), b.upper())]
    rows += ODD
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, -1 if x.component_id is None else x.component_id) for x in neardup.near_duplicates(frame(spark, rows), width, percent).collect())
    assert got == brute_groups(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_copies_of_a_passage_that_many_quote(spark, width, percent):
    """Every bucket of the two has a quoting document as its centre, which its own words bound out."""
    passage = " ".join(f"p{k}" for k in range(150))
    rows = [(k, passage + " " + " ".join(f"own{k}x{i}" for i in range(80))) for k in range(250)]
    rows += [(1000, passage), (1001, passage.replace("p70 ", "edit ") + " tail")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame(spark, rows), width, percent).collect())
    assert got == brute_groups(rows, width, percent) and got[-1][2] == 1000


def test_a_bucket_of_many_heavily_edited_copies(spark):
    """Copies that share buckets, most of them linked with none: neither lost links nor all pairs."""
    r = random.Random(11)
    base = " ".join(f"b{k}" for k in range(120))
    rows = [(k, edited(base, r, r.randint(0, 14))) for k in range(500)]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == brute_groups(rows, 3, 85)


def test_words_of_any_structure_have_their_own_hash():
    from verisift.llm import kernels

    one = "a"
    while len(one) < 4096:  # the Thue-Morse word, which any polynomial modulo 2**64 takes for its complement
        one += one.translate(str.maketrans("ab", "ba"))
        hashes, _ = kernels.word_hashes(*kernels.utf8(pa.array([f"{one} {one.translate(str.maketrans('ab', 'ba'))} x{one}"])))
        assert len(set(hashes.tolist())) == 3
    texts = ["the cat", "thecat", "cat the", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 300, "\x00", "\x00\x00"]
    each = [tuple(kernels.word_hashes(*kernels.utf8(pa.array([t])))[0].tolist()) for t in texts]
    together, offs = kernels.word_hashes(*kernels.utf8(pa.array(texts)))
    assert each == [tuple(together[a:b].tolist()) for a, b in itertools.pairwise(offs.tolist())] and len({x for t in each for x in t}) == 11


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(frame(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


def test_circulant_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    table = neardup.circulant(256)
    a = r.integers(0, neardup.CELLS, 1000)
    b = np.concatenate([a[:700], r.integers(0, neardup.CELLS, 300)])
    same_ = (neardup.signature(a, table) == neardup.signature(b, table)).mean()
    assert abs(same_ - 700 / 1300) < 0.12
    assert (table[5][1:] == table[6][:-1]).all()


# --- 3: nearest neighbours -------------------------------------------------


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = r.standard_normal((700, 24))
    vectors[50:120] = vectors[7]  # copies and ties
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [float("inf")] + [1.0] * 23), (1000, None), (None, [1.0] * 24), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit(0), "n": F.lit(1)})
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in onebit.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 700, 100):
        d = onebit.distances(vectors.T, np.arange(700), vectors.T, np.full(700, q))
        order = [k for k in np.lexsort((np.arange(700), d)) if k != q][:10]
        want += [(q, n + 1, int(k), float(d[k])) for n, k in enumerate(order)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == [x[3] for x in want]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e4, 1e150, 1e200])
def test_near_copies_of_any_length_and_huge_values(spark, scale):
    r = np.random.default_rng(2)
    base = r.standard_normal((30, 32))
    vectors = np.concatenate([base + 1e-5 * r.standard_normal((30, 32)) for _ in range(12)]) * scale
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for x in onebit.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in range(0, 360, 100):
        with np.errstate(over="ignore"):
            d = onebit.distances(vectors.T, np.arange(360), vectors.T, np.full(360, q))
        want = [k for k in np.lexsort((np.arange(360), d)) if k != q][:10]
        assert [x[1] for x in sorted(got[q])] == want and [x[2] for x in sorted(got[q])] == d[want].tolist()


def test_queries_that_share_an_id_have_lists_of_their_own(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [9.0, 1.0]), (1, [0.0, 2.0]), (2, [9.0, 2.0]), (2, [9.0, 3.0])]
    got = sorted((x["rank"], x.vec_id, round(x.score, 3)) for x in onebit.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect())
    assert got == [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 2, 2.0), (2, 2, round(82**0.5, 3)), (2, 2, round(82**0.5, 3))]


def test_blocks_do_not_matter(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, queries.op3_onebit(spark, sf_dir).collect()))
    monkeypatch.setattr(onebit, "BLOCK", 60)
    monkeypatch.setattr(onebit, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, queries.op3_onebit(spark, sf_dir).collect())) == whole


def test_search_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert onebit.search(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    few = onebit.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], schema), F.col("vec_id") == 0).collect()
    assert [tuple(x) for x in few] == [(0, 1, 1, 1.0)]


def test_bounds_hold():
    r = np.random.default_rng(5)
    vectors, centre, turn = r.standard_normal((2000, 64)), np.zeros(64), onebit.rotation(64)
    bits, norm, factor = onebit.code(vectors, centre, turn)
    q = r.standard_normal(64)
    signs = (np.unpackbits(bits, axis=1, count=64) * 2.0 - 1) / 8
    estimate = signs @ (turn @ q / np.linalg.norm(q)) / factor
    true = vectors @ q / np.linalg.norm(q) / norm
    error = onebit.SPREAD * np.sqrt(1 - factor**2) / (factor * np.sqrt(63))
    assert (np.abs(estimate - true) <= error).mean() > 0.999 and abs((estimate - true).mean()) < 0.02


# --- 4: SentencePiece ------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return unigram.load(queries.tokenizer_path("piece_bpe_32k.model"))


def brute_unigram(m, pieces, text):
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    score = {p: i for i, (p, _, k) in enumerate(pieces) if k in (1, 4)}
    most = max(map(len, score))
    best = [(0.0, 0, 0)] + [(-1e18, 0, 0)] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - most), end):
            p = s[start:end]
            if p in score or end - start == 1:
                total = best[start][0] + (m.scores[score[p]] if p in score else m.unknown_score)
                if total > best[end][0]:
                    best[end] = (total, start, score.get(p, -1))
    out, end = [], len(s)
    while end:
        _, start, ident = best[end]
        out.append([ident] if ident >= 0 else [int(m.byte_ids[x]) for x in s[start:end].encode()])
        end = start
    return [x for part in reversed(out) for x in part]


TEXTS = ["Hello world", "a  b   c", " lead", "trail ", "  ", "日本語 テキスト😀 x", "naïve café\n\ttabs", "x" * 300, "\x00\x01", "The quick brown fox's 12345 jumps!"]


def test_viterbi_equals_brute_force_and_round_trips(model, spark, sf_dir):
    pieces, _ = unigram.read_model(queries.tokenizer_path("piece_bpe_32k.model"))
    some = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(8).collect()]
    for text in [*TEXTS, *(t[:400] for t in some)]:
        (ids,) = model.encode([text])
        assert ids.tolist() == brute_unigram(model, pieces, text), text
        assert model.decode(ids) == text


@pytest.mark.parametrize("prefix,squeeze", [(1, 0), (0, 0), (1, 1), (0, 1)])
def test_viterbi_equals_the_library_on_a_unigram_model(tmp_path, prefix, squeeze):
    import sentencepiece as sp

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def sized(b):
        n, out = len(b), b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out + b

    pieces, settings = unigram.read_model(queries.tokenizer_path("piece_bpe_32k.model"))
    assert (settings.model, settings.prefix, settings.squeeze) == (unigram.BPE, True, False)
    scores = unigram.log_scores(pieces, unigram.BPE)
    more = [("<tag>", 0.0, unigram.USER), ("own piece", 0.0, unigram.USER), ("ellohx", 0.0, unigram.USER)]
    data = b"".join(field(1, 2, sized(field(1, 2, sized(p.replace(" ", "▁").encode())) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k])))) for (p, _, k), s in zip([*pieces, *more], [*scores, 0, 0, 0], strict=True))
    trainer = field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7]) + b"\x01"  # kind unigram, byte fallback
    normalizer = field(1, 2, sized(b"identity")) + field(3, 0, bytes([prefix])) + field(4, 0, bytes([squeeze])) + field(5, 0, b"\x01")
    file = tmp_path / "u.model"
    file.write_bytes(data + field(2, 2, sized(trainer)) + field(3, 2, sized(normalizer)))
    library, own = sp.SentencePieceProcessor(model_file=str(file)), unigram.load(str(file))
    for text in [*TEXTS, "an own piece of <tag> hellohx<tag>ellohx", " <tag> ", "", "one", "a   "]:
        if "\x00" not in text:
            assert own.encode([text])[0].tolist() == library.encode(text), text
            assert squeeze or own.decode(own.encode([text])[0]) == text
    (tmp_path / "m.model").write_bytes(data + field(2, 2, sized(trainer)) + field(3, 2, sized(normalizer + field(2, 2, sized(b"map")))))
    with pytest.raises(ValueError):
        unigram.load(str(tmp_path / "m.model"))


def test_trie_holds_exactly_its_keys():
    keys = [(k.encode(), i) for i, k in enumerate(["a", "ab", "abc", "b", "zz", "é", "\xff"])]
    trie = unigram.build_trie(keys)

    def find(key):
        node = 0
        for c in key:
            to = trie.base[node] + c + 1
            if trie.check[to] != node:
                return -1
            node = to
        return trie.value[node]

    assert [find(k) for k, _ in keys] == [i for _, i in keys] and find(b"abcd") == find(b"z") == find(b"c") == -1


def test_unigram_operators_on_odd_rows(spark):
    file = queries.tokenizer_path("piece_bpe_32k.model")
    rows = unigram.digest(frame(spark, ODD), file, with_ids=True).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    back = unigram.decode(unigram.encode(frame(spark, ODD), file), file).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in ODD)
    assert unigram.digest(frame(spark, []), file).count() == 0


# --- 5: pages --------------------------------------------------------------


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), (page(""), ""),
        (page("<nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>One<br>two &lt;b&gt; <b>bold</b>.\n <p>Three<script>x('</p>')</script></article><footer>end</footer>"), "A title\nOne two <b> bold.\nThree"),
        (page("<header>Site</header><main><header><h1>Head</h1></header><p>Text</p><aside>Side</aside><form><p>Form</p></form><section class='comments'><p>Reader</p></section></main>"), "Head\nText"),
        (page("<div class='cookie-notice'>We use cookies</div><div id='sidebar1'>Side</div><div class=content><p>Main</p><ul><li>x<li>y</ul></div><div class='ad'>Buy</div>"), "Main\nx\ny"),
        (page("<div class='main-with-sidebar'><div class='entry-header'><h1>H</h1></div><p>T</p><div class='post-comments'>C</div><div class='pageFooter'>F</div></div>"), "H\nT"),
        (page("<article><p>unclosed <i>tags<p>second<div>third</article>"), "unclosed tags\nsecond\nthird"),
        (page("<article><table><tr><td>a<td>b<tr><td>c</table></article>"), "a\nb\nc"),
        (page("<article class=body data-title='The hidden cost of cars' aria-label='a class=ad b'><p title='What hidden=1 means'>Cars</p><p data-hidden>Too</p><p data-x=hidden>And</p><p class='x'hidden>no</p><p HIDDEN=until-found>no</p></article>"), "Cars\nToo\nAnd"),
        (page("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"), "So x=2 holds."),
        (page("<article><p>1 < 2 & 3 > 2</p><!-- <p>no</p> --><p hidden>no</p></article>"), "1 < 2 & 3 > 2"),
    ],
)
def test_main_text(html, text):
    page_ = pages.parse(html or "")
    assert pages.main_text(page_, pages.by_evidence(page_)) == text


def test_a_deep_page_is_parsed_in_one_pass():
    began = time.perf_counter()
    for piece in ("<div>", "<div><li>", "<p>", "<ul><li>", "</section><div>", "<table><tr><td>"):
        page_ = pages.parse(piece * 100_000 + "text")
        assert page_.blocks[-1][1] == "text" and pages.main_text(page_, {}) == "text"
    assert time.perf_counter() - began < 20


def test_a_nested_table_stays_in_its_cell():
    page_ = pages.parse("<table><tr><td>a<table><tr><td>b<tr><td>c</table>d<tr><td>e</table>")
    up = {text: page_.nodes[k].parent for k, text in page_.blocks}
    assert [t for _, t in page_.blocks] == list("abcde") and page_.nodes[page_.nodes[up["b"]].parent].parent == next(k for k, t in page_.blocks if t == "a")


def test_style_tree_removes_what_a_site_repeats(spark):
    notice = "<div><p>This text stands on every page of the site.</p></div>"
    rows = [(k, f"https://a.example/{k}", page(f"{notice}<section><p>Story {k} of its own.</p><p>More {k * 7}.</p></section>")) for k in range(12)]
    rows += [(100, "https://b.example/", page(f"{notice}<section><p>Alone.</p></section>")), (101, None, None), (102, "no url", page("<p>x</p>")), (100, "https://b.example/", page("<p>twice</p>"))]
    rows += [(200 + k, "https://c.example/", page("<div><p>A copy.</p></div>")) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("z"), "low": F.lit(1), "text": F.lit("t")})
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    assert got[:12] == [(k, f"Story {k} of its own.\nMore {k * 7}.", len(f"Story {k} of its own.\nMore {k * 7}.")) for k in range(12)]
    assert got[12:16] == sorted([(100, "This text stands on every page of the site.\nAlone.", 50), (100, "twice", 5), (101, "", 0), (102, "x", 1)])
    assert all(t == "A copy." for _, t, _ in got[16:])
    tree = {r.node: r for r in pages.style_tree(pages.seen(df)).where(F.col("host") == pages._hash("a.example")).collect()}
    assert tree[pages.node_key("/html/body/div")].importance < pages.THRESHOLD < tree[pages.node_key("/html/body/section")].importance
    assert pages.extract(df.limit(0)).count() == 0


def test_style_tree_judges_within_landmarks(spark):
    notice = "<div><p>This text stands in every article of the site.</p></div>"
    rows = [(k, f"https://a.example/{k}", page(f"<main><article>{notice}<section><p>Story {k} of its own.</p></section></article></main>")) for k in range(12)]
    rows += [(100 + k, "https://c.example/", page("<article><div><p>A copy.</p></div></article>")) for k in range(9)]
    got = sorted((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(k, f"Story {k} of its own.") for k in range(12)] + [(100 + k, "A copy.") for k in range(9)]


def test_the_tree_decides_on_the_tables_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in pages.extract(table).collect()}
    # The opposite of what the tree says, no word from it, and no importance at all.
    other = pages.extract(table, lambda nodes: pages.style_tree(nodes).withColumn("importance", 1 - F.col("importance")))
    silent = pages.extract(table, lambda nodes: pages.style_tree(nodes).withColumn("importance", F.lit(1.0)))
    nothing = pages.extract(table, lambda nodes: pages.style_tree(nodes).withColumn("importance", F.lit(0.0)))
    assert all(texts[r.page_id] != r.text for r in other.collect()) and all(len(texts[r.page_id]) < r.n_chars for r in silent.collect())
    assert {r.text for r in nothing.collect()} == {""}


def test_entropy_moves_what_presentation_leaves_open(spark):
    rows = [(k, f"https://a.example/{k}", page(f"<article><p>Story {k}.</p><div class=related><p>More of us</p></div><div class=share><p>Own words {k}</p></div></article>")) for k in range(8)]
    rows += [(100, "https://b.example/", page("<article><p>Once.</p><div class=related><p>Seen once</p></div></article>")), (101, "https://b.example/x", page("<article><p>Text <object>in an object</object> <noscript>and more</noscript></article>"))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(8)] == [f"Story {k}.\nOwn words {k}" for k in range(8)]
    assert got[100] == "Once.\nSeen once" and got[101] == "Text in an object\nand more"


# --- 6: repeated passages --------------------------------------------------


def brute_removed(rows, width):
    seen: dict = {}
    split = [words(t) for _, t in rows]
    for r, w in enumerate(split):
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((r, k))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for r, k in places:
                gone[r].update(range(k, k + width))
    return [(-1 if i is None else i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for (i, _), w, g in zip(rows, split, gone, strict=True)]


def passages(seed):
    r = random.Random(seed)
    rows = random_docs(80, seed)
    shared = [" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(n)) for n in (20, 34, 35, 36, 60, 90)]
    for k in range(60):
        i, t = rows[r.randrange(80)]
        w, at = t.split(), 0
        at = r.randint(0, len(w))
        rows[i] = (i, " ".join([*w[:at], shared[k % 6], *w[at:]]))
    return [*rows, (500, "la " * 80), (501, "one " + "x y z " * 30), (502, rows[3][1]), *ODD]


@pytest.mark.parametrize("width", [35, 10, 3, 1])
def test_substrings_equal_brute_force(spark, width):
    rows = passages(width)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(frame(spark, rows), width).collect())
    assert got == sorted(brute_removed(rows, width))


def test_covers_are_difference_covers():
    for v, cover in substrings.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_removal_keeps_columns_and_white_space(spark):
    rows = passages(35)
    df = spark.createDataFrame(rows, DOC).withColumns({"g": F.lit(1), "lang": F.lit("en")})
    out = substrings.remove(df)
    assert out.columns == ["doc_id", "text", "g", "lang", "n_removed"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in out.collect())
    assert got == sorted((i, g, h) for i, _, g, h in brute_removed(rows, 35))
    same_text = {r.doc_id: r.text for r in out.where("n_removed = 0").collect()}
    assert same_text[11] == "tail  \n spaces   " and same_text[1] is None
    assert substrings.digest(frame(spark, [])).count() == 0


# --- 7: language -----------------------------------------------------------

EN = "the house that stands on the hill with the old trees and the river below it"
DE = "das haus steht auf dem hügel mit den alten bäumen und dem fluss darunter"
FR = "la maison qui se trouve sur la colline avec les vieux arbres et la rivière"


def labelled(n=40):
    r = random.Random(2)
    rows = []
    for k in range(n):
        for j, (lang, text) in enumerate((("en", EN), ("de", DE), ("fr", FR))):
            w = text.split()
            r.shuffle(w)
            rows.append((3 * k + j, " ".join(w), lang))
    return rows


def test_mixtures():
    model = language.fit([(lang, t) for _, t, lang in labelled()])
    found = language.Detector(model)([EN * 2, f"{EN} {DE}", None, "", "123 !?", "日本"])
    assert found[0][0] == "en" and found[0][1] > 0.95 and list(found[0][2]) == ["en"]
    assert set(found[1][2]) == {"de", "en"} and 0.3 < found[1][2]["de"] < 0.7
    assert [x[:2] for x in found[2:5]] == [("und", 0.0)] * 3 and found[5][0] in ("de", "en", "fr")


def brute_mixture(logs, penalty, enough):
    """Shares of one document from a row of log likelihoods for each word, in plain loops."""
    likely = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60.0))

    def fit(allowed):
        shares = np.array([1 / len(allowed) if j in allowed else 0.0 for j in range(logs.shape[1])])
        while len(allowed) > 1:
            new = np.zeros(len(shares))
            for word in likely:
                new += word * shares / (word * shares).sum()
            new /= new.sum()
            done = np.abs(new - shares).max() < enough
            shares = new
            if done:
                break
        return shares, sum(np.log((word * shares).sum()) for word in likely)

    allowed = set(range(logs.shape[1]))
    shares, best = fit(allowed)
    while len(allowed) > 1:
        weakest = min(allowed, key=lambda j: shares[j])
        new, fewer = fit(allowed - {weakest})
        if 2 * (best - fewer) >= penalty * np.log(max(len(logs), 2)):
            break
        allowed, shares, best = allowed - {weakest}, new, fewer
    return shares


def test_mixtures_equal_brute_force_in_any_company():
    r = random.Random(6)
    parts = [EN.split(), DE.split(), FR.split()]
    texts = [" ".join(r.choice(parts[r.choice([k % 3, (k + k // 3) % 3])]) for _ in range(r.randint(1, 60))) for k in range(60)]
    model = language.fit([(lang, t) for _, t, lang in labelled()])
    together = language.Detector(model)(texts)
    assert together == [x for t in texts for x in language.Detector(model)([t])]
    assert together == [x for k in range(0, 60, 7) for x in language.Detector(model)(texts[k : k + 7])]
    keys = {int(k): n for n, k in enumerate(model.keys)}
    for text, (lang, score, shares) in zip(texts, together, strict=True):
        rows = []
        for word in text.split():
            marked = [2, *map(ord, word), 3]
            rows.append(sum(model.logs[keys.get(a << 42 | b << 21 | c, len(keys))] for a, b, c in zip(marked, marked[1:], marked[2:], strict=False)))
        want = brute_mixture(np.array(rows), language.PENALTY, language.ENOUGH)
        assert model.languages[int(want.argmax())] == lang and abs(want.max() - score) < 5e-3
        assert {model.languages[j] for j in np.flatnonzero(want > 0)} >= {k for k, v in shares.items() if v > 1e-6}


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * 50_000 + f" {k}", f"l{k % 7}") for k in range(40)] + [(100, "y", "l0")], "doc_id long, text string, lang string")
    rows = language.training_rows(docs, F.lit(True), fit_rows=2, fit_languages=3, fit_chars=100)
    assert len(rows) == 6 and max(len(t) for _, t in rows) <= 100 and "l0" in {x for x, _ in rows}


def test_detect_on_odd_rows(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    rows = language.training_rows(docs, queries.learns(), fit_rows=5)
    assert len(rows) == 15 and rows == language.training_rows(docs, queries.learns(), fit_rows=5)
    model = language.fit(rows)
    out = language.detect(frame(spark, ODD).withColumn("score", F.lit("x")), model, ["doc_id", "key"]).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), "und")
    empty = language.fit(language.training_rows(docs.limit(0), F.lit(True)))
    assert {r.lang_pred for r in language.detect(frame(spark, ODD), empty, ["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    found = queries.op7_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.where("lang = lang_pred").count(), found.count()
    assert n and right / n > 0.95


# --- 8: mixing -------------------------------------------------------------


def test_mix_meets_the_weights(spark):
    rows = [(k, "t", f"s{0 if k % 3 == 0 else k % 7 + 1}") for k in range(6000)] + [(None, None, None), (1, "again", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"replica": F.lit("x"), "key": F.lit(3)})
    mixed = mixing.mix(docs, {"s0": 0.1, "s1": 0.3, "s2": 0.0, mixing.REST: 0.6}, size=9000)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 9000) < 400 and abs(n["s0"] / total - 0.1) < 0.02 and abs(n["s1"] / total - 0.3) < 0.02 and "s2" not in n
    first = mixed.where("source = 's1'").groupBy("doc_id").count().groupBy("count").count().collect()
    share = {r[0]: r[1] for r in first}
    assert max(share) > 3  # Poisson, not a fixed count
    assert mixing.mix(docs.limit(0), {"s0": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1.0})


def test_rows_without_an_id_differ_by_text_and_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, f"text {k}", "s") for k in range(300)] + [(None, "copy", "s")] * 300, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"s": 1.0})
    times = {r.text: r["count"] for r in mixed.groupBy("text").count().collect()}
    assert 120 < len(times) < 280 and times.get("copy", 0) % 300 == 0
    sizes = [r["count"] for r in mixing.mix(docs.where("text = 'copy'"), {"s": 1.0}, size=900).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 or not sizes


def test_steps_are_the_distribution_function():
    for mean in (0.01, 0.5, 3.0, 40.0):
        steps = mixing.steps(mean)
        assert abs(steps[-1] - 1) < 1e-12 and steps == sorted(steps)
        p = np.diff([0, *steps])
        assert abs((p * np.arange(len(p))).sum() - mean) < 1e-9


def test_huge_rates_are_sums_of_parts(spark):
    docs = spark.createDataFrame([(k, "t", "s") for k in range(20)], "doc_id long, text string, source string")
    n = mixing.mix(docs, {"s": 1.0}, size=20 * 1300).count()
    assert abs(n - 26_000) < 1000


# --- 9: licenses -----------------------------------------------------------


def base(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


LICENSED = [
    (20, "Released under the MIT License."), (21, "MIT-License, mit license; MIT\nLICENSE and the Apache License, Version 2.0"), (22, "GNU Lesser General Public License version 2.1"), (23, "SPDX-License-Identifier: Apache-2.0"),
    (24, "Licensed under CC BY-NC 4.0."), (25, "summit license, mitlicense, mit licenses"), (26, "This work is licensed under the GNU General Public License, version 3."), (27, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (28, "élicense mit élicense"),
]


def test_licenses(spark):
    rows = [*ODD, *LICENSED]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        n, count, low, high, labels = base(t)
        r = got[i, n]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (count, low, high, labels), t
        assert 0 <= r.score < 1 and set(filter(None, labels.split(","))) <= set(r.labels.split(","))
        assert r.key == "k"
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[22].method_labels == "lgpl-2.1" and by_id[23].method_labels == "apache-2.0" and by_id[24].method_labels == "cc-by-nc-4.0"
    assert by_id[21].labels.split(",") == ["apache", "apache-2.0", "mit"] and by_id[27].labels == "mit" and by_id[25].n_base == 0
    assert licenses.scan(frame(spark, [])).count() == 0


def test_rules_are_gated_by_their_keyword():
    assert len(licenses.RULES) > 250
    for label, keyword, pattern in licenses.RULES:
        re.compile(pattern)
        assert label and keyword and any(keyword.startswith(g) or g == "licen" for g in licenses.GATE)


def sample(parsed, r):
    """A match of a parsed pattern, its choices made by r."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op in ("NOT_LITERAL", "ANY"):
            out += "q"
        elif op == "IN":
            kind, y = r.choice([("CATEGORY", None)] if str(x[0][0]) == "NEGATE" else [(str(k), v) for k, v in x])
            out += chr(y) if kind == "LITERAL" else chr(r.randint(*y)) if kind == "RANGE" else "q" if y is None else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "1", "CATEGORY_NOT_SPACE": "q", "CATEGORY_WORD": "w"}[str(y)]
        elif op == "BRANCH":
            out += sample(r.choice(x[1]), r)
        elif op == "SUBPATTERN":
            out += sample(x[3], r)
        elif op == "MAX_REPEAT":
            out += "".join(sample(x[2], r) for _ in range(r.randint(x[0], min(x[1], x[0] + 1))))
        else:
            assert op in ("AT", "ASSERT_NOT", "ASSERT"), op
    return out


def test_every_match_of_a_rule_passes_its_keyword_and_the_gate():
    r = random.Random(5)
    gate = re.compile(rf"\b(?:{'|'.join(map(licenses._literal, licenses.GATE))})", re.I | re.A)
    for label, keyword, pattern in licenses.RULES:
        found = {x for x in (sample(re._parser.parse(pattern), r) for _ in range(60)) if re.search(pattern, x, re.A)}
        assert found, pattern
        for x in found:
            assert keyword in x and gate.search(x), (label, keyword, x)


def test_detections_equal_brute_force(spark):
    """Every rule's own matches, alone and in company, against a plain search with the same order and containment."""
    r = random.Random(12)
    found = [sample(re._parser.parse(pattern), r) for _, _, pattern in licenses.RULES for _ in range(2)]
    texts = found + [r.choice([" ", ". ", "\n"]).join([*r.sample(found, r.randint(1, 6)), "MIT License"][:: r.choice([1, -1])]) for _ in range(300)]
    compiled = [(label, keyword, re.compile(pattern, re.A)) for label, keyword, pattern in licenses.RULES]
    gate = re.compile(rf"\b(?:{'|'.join(map(licenses._literal, licenses.GATE))})", re.I | re.A)

    def brute(text):
        low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        hits = [(m.start(), -m.end(), k, label) for k, (label, keyword, p) in enumerate(compiled) if keyword in low for m in p.finditer(low)] if gate.search(text) else []
        kept = [h for h in hits if not any(g[0] <= h[0] and g[1] <= h[1] and g[:3] != h[:3] and (g[:2] != h[:2] or g[2] < h[2]) for g in hits)]
        return ",".join(sorted({h[3] for h in kept})), len(kept)

    rows = licenses.scan(frame(spark, list(enumerate(texts)), extra=False)).select("doc_id", "method_labels", "n_detections").collect()
    for row in rows:
        assert (row.method_labels, row.n_detections) == brute(texts[row.doc_id]), texts[row.doc_id]
    assert len({x for row in rows for x in row.method_labels.split(",")}) > 200


def test_names_without_the_keyword_of_another_name(spark):
    rows = [(1, "MIT No Attribution"), (2, "CreativeML Open RAIL-M"), (3, "the Expat License"), (4, "Unicode Terms of Use"), (5, "OpenRAIL-M, MIT-0")]
    got = {x.doc_id: x.method_labels for x in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: "mit-0", 2: "openrail", 3: "mit", 4: "unicode", 5: "mit-0,openrail"}


# --- 10: token store -------------------------------------------------------


def test_token_store_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = [x for x in ODD if x[0] not in (9, 10, None)] + [(30, "a \n b \n \n c"), (31, "<|endoftext|> x"), (32, "a <|endoftext|> b"), (33, "a  "), (34, "  a   b \n  c"), (35, "x<|endoftext|>"), (36, "\u00a0 \u2003 z \x1c  \x85 y"), (37, " "), (38, "it's we'll  I'M 12ab\n\n "), *[(100 + k, x) for k, (_, x) in enumerate(random_docs(30, 4, most=2000))], (90, "copy " * 3000), (91, "copy " * 3000)]
    got = token_store.token_store(frame(spark, rows), queries.tokenizer_path("byte_bpe_50k.json"), at=str(tmp_path / "store")).orderBy("doc_id").collect()
    at = 0
    for (i, text), r in zip(sorted(rows), got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True), i
        at += len(ids)
    stored = {r.doc_id: r for r in token_store.read_ids(spark, str(tmp_path / "store")).collect()}
    assert all(stored[i].verified and stored[i].ids == [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text in rows) and len(stored) == len(rows)
    chunks = spark.read.parquet(str(tmp_path / "store/chunks"))
    assert chunks.count() == chunks.select("name").distinct().count()


def test_encoder_equals_the_library_on_odd_strings():
    from tokenizers import Tokenizer

    file = queries.tokenizer_path("byte_bpe_50k.json")
    t, own, r = Tokenizer.from_file(file), token_store.WordEncoder(file), random.Random(8)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "Be", "the", "12", "'s", "é", "日", "😀", ".", "...", "_", "\x00", "<|endoftext|>", "Ġ"]
    batch = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    batch += ["été, naïve.\nÉcole;\nx", "a.b", "don't", "x!?\ny", "ß.ſ ĳ", "a\n.b c", "a\n\nb c", None]
    for at in range(0, len(batch), 500):
        ids, offs = own(pa.array(batch[at : at + 500], pa.string()).slice(3), 7)
        for k, text in enumerate(batch[at + 3 : at + 500]):
            assert ids[offs[k] : offs[k + 1]].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7], text
    assert [x.tolist() for x in own(pa.array([], pa.string()), 0)] == [[], [0]]


def test_manifest_is_the_merkle_root_of_the_documents(spark, tmp_path):
    at = str(tmp_path / "store")
    token_store.write_store(spark.createDataFrame([(k, f"text {k}") for k in range(23)], DOC).union(spark.createDataFrame([(None, "same")] * 40, DOC)), at, queries.tokenizer_path("byte_bpe_50k.json"), 0)
    by_part: dict = {}
    for r in token_store._recipes(spark, at).orderBy("rid").collect():
        by_part.setdefault(r.part, []).append(bytes(r.root))
    assert {r.part: bytes(r.root) for r in spark.read.parquet(f"{at}/manifest").collect()} == {k: token_store.merkle(v) for k, v in by_part.items()}
    assert len(by_part) > 1 and max(map(len, by_part.values())) < 40  # rows without an id are dealt out
    assert token_store.store_is_whole(spark, at) and len(token_store.manifest_root(spark, at)) == 16
    assert token_store.manifest_root(spark, at) == token_store.merkle([token_store.merkle(by_part[k]) for k in sorted(by_part)])


def test_token_store_finds_damage(spark, tmp_path):
    at = str(tmp_path / "store")
    token_store.write_store(spark.createDataFrame([(1, "some words here"), (2, "other words")], DOC), at, queries.tokenizer_path("byte_bpe_50k.json"), 0)
    rows = spark.read.parquet(f"{at}/chunks").collect()
    rows = [(rows[0].name, rows[0].n, bytearray(token_store.pack(np.array([1, 2, 3])))), *[(r.name, r.n, r.body) for r in rows[1:]]]
    spark.createDataFrame(rows, "name binary, n int, body binary").write.mode("overwrite").parquet(f"{at}/damaged")
    import shutil

    shutil.rmtree(f"{at}/chunks")
    shutil.move(f"{at}/damaged", f"{at}/chunks")
    assert sorted(r.verified for r in token_store.read_store(spark, at).collect()) == [False, True]


def test_shared_ids_and_empty_table(spark):
    file = queries.tokenizer_path("byte_bpe_50k.json")
    rows = token_store.token_store(frame(spark, ODD), file).collect()
    assert len(rows) == len(ODD) and all(r.verified for r in rows)
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert token_store.token_store(frame(spark, []), file).count() == 0


def test_cuts_follow_the_content():
    cuts = lambda ids: token_store.cuts(len(ids), token_store.marks(ids).tolist())
    ids = np.random.default_rng(0).integers(0, 50_000, 60_000).astype("<u4")
    a, b = cuts(ids), cuts(np.concatenate([ids[:100][::-1], ids]))
    assert a[-1] == 60_000 and max(np.diff([0, *a])) <= token_store.MAX
    assert len({x + 100 for x in a} & set(b)) > 0.8 * len(a)
    assert cuts(np.zeros(1, "<u4")) == [1] and cuts(np.zeros(20_000, "<u4"))[-1] == 20_000


# --- pipeline --------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    rows = []
    for k, text, lang in labelled(20):
        w = text.split() * 8
        r.shuffle(w)
        rows.append((k, " ".join(w) + f" unique{k}", lang, f"src{k % 7}", 5))
    rows += [(700 + k, rows[k][1] + " tail", "en", "src9", 5) for k in range(5)] + [(800, rows[7][1], None, None, None), (801, None, "en", "src1", 0), (802, "12 34", "en", "src1", 5), (803, "", None, None, 0), (3, rows[3][1], "en", "src0", 5)]
    passage = " ".join(f"pass{k}" for k in range(50))
    rows += [(900 + k, f"{EN} {' '.join(f'only{k}x{j} the' for j in range(60))} {passage} und {FR} number{k}", "en", "src2", 5) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    at = str(tmp_path / "sf")
    docs.write.parquet(f"{at}/documents.parquet")
    now = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.replace(" ", "-"))
        stage(spark, now, at).write.parquet(out)
        seen[name], now = now, spark.read.parquet(out)
        if name != "token ids":
            assert now.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert {x.doc_id for x in now.collect()} == {x[0] for x in rows} - {801, 802, 803}
            model = language.fit(language.training_rows(docs, F.lit(True)))
            keys = {int(k): n for n, k in enumerate(model.keys)}
            for x in now.collect():
                logs = []
                for word in re.findall(r"[^\W\d_]+", x.text.lower()):
                    marked = [2, *map(ord, word), 3]
                    logs.append(sum(model.logs[keys.get(a << 42 | b << 21 | c, len(keys))] for a, b, c in zip(marked, marked[1:], marked[2:], strict=False)))
                want = brute_mixture(np.array(logs), language.PENALTY, language.ENOUGH)
                assert x.lang == model.languages[int(want.argmax())] and want.max() >= corpus_pipeline.LEAST_SHARE - 5e-3
        if name == "near duplicates":
            given = [(x.doc_id, x.text) for x in seen[name].collect()]
            kept = {i for i, _, c in brute_groups(given, 5, 80) if i == c}
            assert sorted(x.doc_id for x in now.collect()) == sorted(kept)
        if name == "repeated passages":
            given = [(x.doc_id, x.text) for x in seen[name].collect()]
            want = {i: h for i, _, _, h in brute_removed(given, 35)}
            assert {x.doc_id: hashlib.sha256(" ".join(words(x.text)).encode()).hexdigest() for x in now.collect()} == want
            assert not any("pass1 " in x.text for x in now.collect())
        if name == "mixing":
            given = seen[name].collect()
            keys = [x.source if x.source in queries.WEIGHTS else mixing.REST for x in given]
            means = mixing.rates({k: keys.count(k) for k in set(keys)}, queries.WEIGHTS, len(given))
            want = []
            for x, k in zip(given, keys, strict=True):
                u = int(hashlib.md5(f"17/{x.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
                want += [(x.doc_id, x.text)] * sum(step <= u for step in mixing.steps(means[k]))
            assert sorted((x.doc_id, x.text) for x in now.collect()) == sorted(want)
        if name == "token ids":
            assert now.count() == seen[name].count() and now.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, at).count() == now.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
