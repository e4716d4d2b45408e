"""Hard negatives, packed files of ids and vector codes against brute force and SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitpack, hard_negatives, vector_codes
from tessera.llm.balltree import ball_tree
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_ball_tree_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (500, 7)).astype(float), rng.normal(0, 300, (40, 7))
    x[100:200] = x[0]  # copies are dealt to both sides of a split
    tree = ball_tree(x, 8)
    assert sorted(tree.order) == list(range(500))
    norm = np.sqrt((q**2).sum(1))
    for node in range(len(tree.lo)):
        rows = x[tree.order[tree.lo[node] : tree.hi[node]]]
        products, far = q @ rows.T, np.sqrt(((q[:, None] - rows[None]) ** 2).sum(2))
        below, above = tree.product_bounds(node, q, norm)
        assert (products.min(1) >= below).all() and (products.max(1) <= above).all() and (far.min(1) >= tree.nearest_bound(node, q)).all()
        if tree.left[node] < 0:
            assert tree.hi[node] - tree.lo[node] <= 8


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_vector_codes"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_sql(spark, name, sf):
    got = QUERIES[name](spark, sf).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    said = db.sql(ORACLE_SQL[name]).df()
    keys = [c for c in ("anchor_id", "positive_id", "rank", "vec_id") if c in said]
    assert len(got) and got.sort_values(keys).reset_index(drop=True).equals(said[got.columns].sort_values(keys).reset_index(drop=True))


def brute_negatives(rows, positives, k, window):
    """rows: {id: (label, integer vector)}."""
    out = []
    for a, (label, v) in rows.items():
        if a % 10:
            continue
        scores = sorted(((-int(v @ x), i, of) for i, (of, x) in rows.items() if i != a))
        for s, i, _ in [t for t in scores if t[2] == label][:positives]:
            fit = [(n, j) for n, j, of in scores if of != label and window[0] * -s <= 100 * -n <= window[1] * -s]
            out += [(a, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(fit[:k])]
    return sorted(out)


@pytest.mark.parametrize("leaf,shard_rows", [(4, 60), (16, 10_000)])
def test_op11_ties_and_odd_rows(spark, leaf, shard_rows):
    """Few distinct values, so most scores tie; a label of half the rows, a label of one row, nulls, repeats, other lengths."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 4, (400, 3)) / 256
    labels = np.where(rng.random(400) < 0.5, 7, rng.integers(0, 6, 400))
    labels[30] = 99  # an anchor without others of its label
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(1000, None, 1), (1010, [1.0, float("nan"), 1.0], 1), (1020, [1.0, None, 1.0], 1), (1030, [1.0, 1.0, 1.0], None), (1040, [1.0, 2.0], 7), (None, [1.0, 1.0, 1.0], 1), rows[5], rows[5], (8, [9.0, 9.0, 9.0], 50)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, label int, score int, id int").repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("label"), positives=4, k=6, window=(20, 100), shard_rows=shard_rows, leaf=leaf).toPandas()
    want = brute_negatives({i: (k, np.floor(256 * np.array(v)).astype(int)) for i, v, k in rows}, 4, 6, (20, 100))
    assert sorted(map(tuple, got.to_numpy().tolist())) == want and len(want) > 300


def test_op11_prunes():
    """Clustered rows: most products are never computed, and the results are those of a full scan."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 100, (40, 16))
    x = np.rint(centers[rng.integers(40, size=8000)] + rng.normal(0, 4, (8000, 16)))
    ids, labels = rng.permutation(8000), rng.integers(0, 3, 8000)
    forest = hard_negatives.Forest(ids, labels, x, 32)
    q = np.arange(0, 8000, 200)
    best = (x[q] @ x.T).max(1).astype(int)
    lo, hi = (best * 0.7).astype(int)[:, None], (best * 0.9).astype(int)[:, None]
    keys = forest.search(ids[q], labels[q], x[q], lo, hi, False, 10)
    for i, a in enumerate(q):
        s = (x @ x[a]).astype(int)
        fit = np.flatnonzero((labels != labels[a]) & (s >= lo[i]) & (s <= hi[i]))
        want = fit[np.lexsort((ids[fit], -s[fit]))][:10]
        found = keys[i, 0][keys[i, 0] != hard_negatives.NOTHING]
        assert (found // 8000).tolist() == s[want].tolist() and forest.ids[7999 - found % 8000].tolist() == ids[want].tolist()
    assert forest.looked < 0.5 * len(q) * 8000


def test_op11_refuses_what_is_not_exact(spark):
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int"), F.col("id") == 0, F.col("label")).collect()


# Vector codes


def brute_codes(x, parts, entries, rounds):
    """Codes, errors and codebooks of integer vectors in order of their ids."""
    cut = x.reshape(len(x), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        d = ((cut[:, :, None] - books[None]) ** 2).sum(3)
        codes = d.argmin(2)  # the first of equal ones
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (codes[:, p] == e).any():
                        mine = cut[codes[:, p] == e, p]
                        books[p, e] = mine.sum(0) // len(mine)
    return codes, d.min(2).sum(1), books


@pytest.mark.parametrize("n,dims,parts,entries,spread", [(300, 12, 4, 9, 3), (5, 7, 4, 16, 2), (200, 3, 2, 40, 200)])
def test_codes_against_brute_force(spark, n, dims, parts, entries, spread):
    """Small integers, so that most distances tie; fewer rows than entries; a length that the parts do not divide; repeated ids."""
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, dims))
    x[n // 2 :: 3] = x[0]
    ids = np.sort(rng.integers(0, 10 * n, n))
    order = sorted(range(n), key=lambda i: (ids[i], x[i].tolist()))
    df = spark.createDataFrame([(int(ids[i]), (x[i] / 16).tolist(), None if i % 3 else i % 4) for i in range(n)], "vec_id long, embedding array<double>, label int").repartition(4)
    kept = vector_codes.kept_vectors(df, "vec_id", "embedding", "label").cache()
    books = vector_codes.trained_codebooks(kept, parts, entries, 3, 16)
    got = vector_codes.vector_codes(kept, books, 16)
    wide = np.concatenate([x[order], np.zeros((n, -dims % parts), int)], axis=1)
    codes, error, said = brute_codes(wide, parts, entries, 3)
    assert (books == said).all()
    assert sorted((r.id, list(r.codes), r.error) for r in got.collect()) == sorted((int(ids[i]), c.tolist(), int(e)) for i, c, e in zip(order, codes, error, strict=True))
    back = vector_codes.decoded(got, books, 16).collect()
    assert all(np.array_equal(np.array(r.v), np.concatenate([said[p, c] for p, c in enumerate(r.codes)]) / 16) for r in back)


def test_codebook_skips_nodes_and_keeps_ties():
    rng = np.random.default_rng(3)
    entries = rng.integers(-5, 6, (64, 2))
    x = rng.integers(-7, 8, (3000, 2))
    index, best = vector_codes.Codebook(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_op13_odd_rows(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0] * 4, None if i % 2 else 3) for i in range(40)]
    odd = [(100, None, 1), (101, [float("inf")] * 8, 1), (102, [None] * 8, 1), (103, [1.0] * 5, 1), (None, [2.0] * 8, 3), rows[0]]
    spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id long, embedding array<double>, label int, error int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_vector_codes"](spark, str(tmp_path)).toPandas()
    assert len(got) == 42 and got.vec_id.isna().sum() == 1 and (got.vec_id == 0).sum() == 2 and got.codebooks_sha256.nunique() == 1
    coded = spark.createDataFrame([(1, 1, 5), (2, None, 7), (3, None, 8), (4, 1, 1)], "id long, label int, error long")
    for most in (0, 10):  # joined, broadcast
        assert sorted((r.id, r.label_error) for r in vector_codes.label_errors(coded, most).collect()) == [(1, 6), (2, 15), (3, 15), (4, 6)]


# Packed files


@pytest.mark.parametrize("bits", [1, 3, 11, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 1 << bits, n).astype(np.uint32)
        words = bitpack.pack(x, bits)
        assert len(words) == -(-n // 64) * bits and (bitpack.unpack(words, bits, n) == x).all()
    whole = int.from_bytes(bitpack.pack(np.array([1, 0, 1], np.uint32), bits).tobytes(), "little")
    assert whole == 1 | 1 << 2 * bits


def test_file(tmp_path):
    """Blocks of 64 ids, documents over many blocks, empty ones, null ids; any span is read by its blocks alone."""
    rng = np.random.default_rng(4)
    docs = [(None if i == 3 else i - 5, rng.integers(0, 1 << 13, n).astype(np.uint32)) for i, n in enumerate([0, 5, 700, 0, 64, 63, 1, 3000, 0])]
    built = bitpack.FileBuilder(13, 64)
    for i, x in docs:
        built.add(i, x)
    path = tmp_path / "x.bits"
    path.write_bytes(b"".join(built.content()))
    file, flat = bitpack.PackedFile(str(path)), np.concatenate([x for _, x in docs])
    assert path.stat().st_size < 13 * len(flat) / 8 + 24 * len(docs) + 8 * (len(flat) / 64 + 20)
    assert file.null.tolist() == [i is None for i, _ in docs] and all((file.document(k) == x).all() for k, (_, x) in enumerate(docs))
    for a, b in rng.integers(0, len(flat) + 1, (50, 2)):
        assert (file.ids(int(min(a, b)), int(max(a, b))) == flat[min(a, b) : max(a, b)]).all()
    for step in (1, 500, 10**6):
        assert [(k, x.tolist()) for k, x in file.documents(step)] == [(k, x.tolist()) for k, (_, x) in enumerate(docs)]
    with pytest.raises(ValueError, match="does not fit"):
        built.add(1, np.array([1 << 13], np.uint32))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bitpack.default_tokenizer())


def said(library, rows, end=(2,)):
    out, at = [], 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_op12(spark, library):
    got = QUERIES["op12_bit_packing"](spark, SF).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    want = said(library, zip(docs.doc_id, docs.text, strict=True))
    assert list(map(tuple, got[["doc_id", "start", "n_tokens", "ids_crc32"]].to_numpy().tolist())) == [w[:4] for w in want]


def test_op12_odd_rows(spark, library):
    """Several files for each task; nulls, empty and long texts, blanks that the ranks refuse, special tokens, repeated and null ids."""
    texts = [None, "", "  a\n\n b\t", "x<|endoftext|> y", "it's  1234 ünïcode 你好   z", "word " * 20_000, " " * 300_000 + "end", "a" * 5000, "👩‍👩‍👧 é́"]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(2, "second of two"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, start int").coalesce(1)
    for file_ids, block in ((1000, 64), (1 << 20, 8192)):
        manifest = bitpack.pack_documents(df, block_ids=block, file_ids=file_ids)
        got = bitpack.read_documents(manifest).orderBy("start").collect()
        want = said(library, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))  # stable: repeated ids in the order of the scan
        assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got] == want
    files = manifest.orderBy("part", "seq").collect()
    assert sum(r.n_docs for r in files) == len(rows)


def test_encoder_falls_back(library, tmp_path):
    """A file whose merges are not in the order of ids goes to the library itself, with the same results."""
    import json

    spec = json.load(open(bitpack.default_tokenizer(), encoding="utf-8"))
    fast = bitpack.ByteBpe(bitpack.default_tokenizer())
    m = spec["model"]["merges"]
    m[0], m[1] = m[1], m[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    slow = bitpack.ByteBpe(str(path))
    assert fast.ranks and not slow.ranks
    text = "the tat hat <|endoftext|> at 's"
    assert fast.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert slow.encode(text).tolist() == slow.plain.encode(text, add_special_tokens=False).ids


def test_digest_of_codebooks(spark):
    """The digest is that of all entries by part, entry and place."""
    kept = vector_codes.kept_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding", "label")
    x = np.stack([np.floor(4096 * np.array(r.v)).astype(int) for r in kept.orderBy("id").collect()])
    books = brute_codes(x, 8, 16, 6)[2]
    got = QUERIES["op13_vector_codes"](spark, SF).select("codebooks_sha256").first()[0]
    assert got == hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
