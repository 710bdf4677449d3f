"""Operators on small inputs: plain Python counterparts, round trips, nulls, ties, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import compare
from listingmart.llm import ann, chat, html_text, langid, mixing, ngram_join, oracle, packing, queries, topk, toxicity, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, size int, _salt int, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, 7, 7, "x") for i, t, lang, src in rows], DOCS)


def odd_docs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    return docs(spark, [(1, None, "en", "a"), (2, "", None, None), (3, "a b", "en", "a"), (3, "a b", "en", "a"), (None, "A b", "en", None), (5, long, None, "b"), (6, long + " end", "de", "b"), (7, " \n\t", "en", "c")])


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, name):
    df = queries.registered()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows and not compare.differences(df.columns, rows, compare.connect(SF), oracle.statements()[name])


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = []
    for i in range(200):
        text = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            text[rng.randrange(len(text))] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(text).upper() if i % 3 else " ".join(text)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, " \t")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert sorted(map(tuple, ngram_join.similar(df).collect())) == brute.classes(rows)


def test_classes_of_odd_rows(spark):
    found = ngram_join.similar(odd_docs(spark).withColumnRenamed("doc_id", "id")).collect()
    by = {(r.id, r.n_shingles): r.component_id for r in found}
    assert len(found) == 8 and by[3, 1] == 3 and by[1, 0] == 1 and by[None, 1] is None and by[6, 29997] == 5
    assert ngram_join.similar(odd_docs(spark).withColumnRenamed("doc_id", "id").limit(0)).count() == 0


def test_pieces_join_to_the_ids(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    rows = packing.packed(odd_docs(spark), path).toPandas()
    plain = Tokenizer.from_file(path)
    for doc_id, text in ((5, " ".join(f"w{i}" for i in range(30_000))), (3, "a b"), (2, "")):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == doc_id].drop_duplicates("start").sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, window in rows.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == [0, *window.length.cumsum().tolist()[:-1]] and window.length.sum() <= 4096
    assert packing.packed(odd_docs(spark).limit(0), path).count() == 0


def test_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer(), random.Random(1)
    parts = ["a", "A", "'", "'s", " ", "é", "́", "3", "!", "'T", "\x1c", "\x85", "\n", "<|endoftext|>", "<|", "İ", "Σ", ".", "١", "½", "\xa0", "ß", "日", "x" * 60, "Ñ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    found, plain = packing.Encoder(path).encode([t.encode() for t in texts]), Tokenizer.from_file(path)
    assert all(a.tolist() == b.ids for a, b in zip(found, plain.encode_batch(texts, add_special_tokens=False), strict=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")


ODD_VECTORS = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [1.0, None], 1), (4, [0.0, 0.0], 1), (5, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [float("inf"), 0.0], 1), (8, [-3.0, 1.5], 1), (None, [1.0, 1.0], 1)]


def test_searches_of_odd_vectors(spark):
    found = topk.search(vectors(spark, ODD_VECTORS), "vec_id", "embedding", F.col("vec_id") == 0, 3)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 5, 327680), (0, 2, 6, 327680), (0, 3, 4, 0)]
    near = ann.search(vectors(spark, ODD_VECTORS), "vec_id", "embedding", F.col("vec_id") == 0, 3)
    assert [tuple(r)[:3] for r in near.orderBy("rank").collect()] == [(0, 1, 5), (0, 2, 6), (0, 3, 8)]
    for search in (topk.search, ann.search):
        assert search(vectors(spark, []), "vec_id", "embedding", F.col("vec_id") == 0, 3).count() == 0


def test_recall_of_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    data = np.stack(table.embedding).astype(float)
    found = queries.op1_ann(spark, "/root/testdata/sf0.1").toPandas()
    hits = 0
    asked = np.flatnonzero(table.vec_id % 100 == 0)
    for i in asked:
        away = np.sqrt(((data - data[i]) ** 2).sum(1))
        away[i] = np.inf
        true = set(table.vec_id[np.argsort(away)[:10]])
        own = found[found.query_id == table.vec_id[i]].sort_values("rank")
        assert len(own) == 10 and np.allclose(own.score, away[own.vec_id.to_numpy()], rtol=1e-14)
        hits += len(true & set(own.vec_id))
    assert hits >= 0.9 * 10 * len(asked)


def test_archives(spark, folder):
    warc.register(spark)
    same = "x" * 1000
    rows = [(1, "http://a/\nb", same), (2, None, same), (3, "u", None), (4, "u", "é" * 600), (5, "u", ""), (6, "u", same), (6, "u", same)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("keep", F.lit(1))
    warc.archive(pages, f"{folder}/a")
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, f"{folder}/a", "bigint").collect()}
    sha = hashlib.sha1(same.encode()).hexdigest()
    assert found[1] == found[2] == (1000, sha, "revisit", 6) and found[6] == (1000, sha, "response", None)
    assert found[3] == found[5] == (0, hashlib.sha1(b"").hexdigest(), "response", None) and found[4][0] == 1200
    full = spark.read.format("warc").load(f"{folder}/a")
    assert full.filter("record_type = 'revisit' AND payload IS NOT NULL").filter(F.length("payload") > 0).count() == 0
    assert full.filter(F.col("target_uri") == "http://a/%0Ab").count() == 1
    reader = warc.WarcReader(warc.T.StructType.fromDDL("record_type string"), {"path": f"{folder}/a"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_archives_of_other_writers(spark, folder):
    import gzip

    def record(kind, block, names=str, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", **more, "Content-Length": str(len(block))}
        head = "".join(f"{names(k)}: {v}\r\n" for k, v in fields.items()).encode("latin-1")
        return b"WARC/1.0\r\n" + head + b"\r\n" + block + b"\r\n\r\n"

    http = {"Content-Type": "application/http; msgtype=response"}
    body = "Grüße\r\n\r\nx".encode()
    records = [
        record("warcinfo", b"software: x\r\nformat: y\r\n", **{"Content-Type": "application/warc-fields"}),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", str.lower, **{"Content-Type": "application/http; msgtype=request"}),
        record("response", b"HTTP/1.1 200 OK\r\ncontent-length: 12\r\nX-Caf\xe9: \xe9\r\n\r\n" + body, str.upper, **http, **{"WARC-Target-URI": "http://a/caf\xe9"}),
        record("resource", body, **{"Content-Type": "text/plain"}),
        record("metadata", b"", **{}),
        record("response", b"HTTP/1.1 204 No Content", **http),
        record("response", b"HTTP/1.0 200 OK\nA: b\n\nplain", **http),
    ]
    with gzip.open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(b"".join(records))
    warc.register(spark)
    found = [(r.record_type, r.payload_length, bytes(r.payload)) for r in spark.read.format("warc").load(folder).collect()]
    info = b"software: x\r\nformat: y\r\n"
    assert found == [
        ("warcinfo", len(info), info), ("request", 0, b""), ("response", 12, body), ("resource", len(body), body), ("metadata", 0, b""),
        ("response", 0, b""), ("response", 5, b"plain"),
    ]
    assert [r.target_uri for r in spark.read.format("warc").load(folder).filter("target_uri IS NOT NULL").collect()] == ["http://a/caf\xe9"]
    assert spark.read.format("warc").load(folder).filter("record_type = 'request'").select("record_id").collect()[0][0] == "<urn:request>"


def test_mix_of_odd_rows(spark):
    found = mixing.mixed(odd_docs(spark)).collect()
    sources = {r.source: r.target for r in found}
    sizes = {r.source: r.source_size for r in found}
    assert len(found) == 8 and sum(sources.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(sources[s] <= 2 * sizes[s] and r.copies <= 2 for s in sources for r in found)
    assert mixing.mixed(odd_docs(spark).limit(0)).count() == 0
    assert mixing.repeated(odd_docs(spark)).columns == odd_docs(spark).columns


def test_layouts_and_round_trip(spark):
    records = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"i","input":"","output":"o"}', '{"x":1}', None, "no"]
    df = spark.createDataFrame(list(enumerate(records)), "k bigint, rec string")
    turns = chat.from_json(df, "k", "rec")
    got = [(r.conv_id, r.layout, r.role, r.text) for r in turns.orderBy("conv_id", "turn").collect()]
    assert got == [(0, "messages", "user", "hi"), (0, "messages", "assistant", ""), (1, "conversations", "user", "q"), (1, "conversations", "assistant", "a"), (2, "instruction_input", "user", "i"), (2, "instruction_input", "assistant", "o"), *((k, None, None, None) for k in (3, 4, 5))]
    texts = ["", "\\", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "a\\\\<|\n", "日\n\n"]
    odd = spark.createDataFrame([(1, i, t if i == 2 else "assistant", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    back = chat.parsed(chat.formatted(odd)).orderBy("turn").collect()
    assert [r.read_text for r in back] == texts and back[2].read_role == texts[2] and back[3].learned == texts[3] and back[2].learned is None
    with pytest.raises(ValueError, match="No layout"):
        chat.from_rows(df, "k", "turn")


def test_main_text(spark):
    page = """<title>t</title><body><header class=site>Shop</header><nav><a href=/>Home</a></nav><div class="ad">Buy it now</div>
    <article><h1>Head &amp; line</h1><p>Some <b>bold&nbsp; text</b> here<p>and<script>x="</p>"</script> more.<div class=comments><p>Nice words by a reader</p></div></article>
    <aside>Read this too, it is very long and full of words</aside><footer>&copy; me</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>a < b" + " word" * 50)]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))).collect()
    assert found[0].text == "Head & line Some bold text here and more." and found[0].n_chars == len(found[0].text)
    assert [r.text for r in found[1:4]] == ["", "", ""] and found[4].text.startswith("a < b word")


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    langs = queries.op5_langid(spark, sf).filter("held_out").join(truth, "doc_id")
    assert langs.filter("lang = lang_pred").count() > 0.98 * langs.count()
    scored = queries.op3_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hits, toxic, said = scored.selectExpr("count_if(toxic = 1 AND predicted = 1)", "count_if(toxic = 1)", "count_if(predicted = 1)").first()
    assert 2 * hits / (toxic + said) > 0.75


def test_classifiers_on_odd_rows(spark):
    odd = odd_docs(spark)
    fitted = langid.fit(["the house and the dog", "das haus und der hund"] * 20, ["en", "de"] * 20)
    found = {r.doc_id: r.lang_pred for r in langid.identified(odd, fitted).collect()}
    assert found[1] == found[2] == found[7] == "und" and found[5] in ("de", "en")
    assert langid.fit([], []).langs == [] and langid.identified(odd, langid.fit([], [])).count() == 8
    net = toxicity.fit([], np.zeros(0, np.int64), [])
    assert all(r.score == pytest.approx(0.01) for r in toxicity.scored(odd, net).collect())
    assert toxicity.kept(odd, net).count() == 8
