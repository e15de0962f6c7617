"""Text, date and vector functions."""

from pyspark.sql import functions as F

from docketeer.functions import dates as D
from docketeer.functions import text as T
from docketeer.functions import vectors as V


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("o")).first()[0]


def test_normalize(spark):
    assert one(spark, " He\tSaid:  O'Neil-Co. é ", T.normalize) == "he said: oneil-co."
    assert one(spark, None, T.normalize) == ""


def test_noise_rules(spark):
    cases = {("The Board", "Person"): True, ("Anna Smith", "Person"): False, ("Dr. Smith", "Person"): True, ("District Court", "Person"): True, ("Acme Case", "Organization"): True, ("2020 Fund", "Organization"): True, (None, None): True, ("x --> y", None): True, ("Acme Corp", None): False}
    df = spark.createDataFrame(list(cases), "n string, k string")
    got = {(r.n, r.k): r.x for r in df.select("n", "k", T.extractor_noise(F.col("n"), F.col("k")).alias("x")).collect()}
    assert got == cases


def test_entity_forms(spark):
    df = spark.createDataFrame([("n12ab", "Aircraft"), ("(212) 555-0100", "Phone"), ("A@B.Com", "Email"), ("pat o'neil Jr.", "Person")], "r string, k string")
    assert [r[0] for r in df.select(T.normalize_entity(F.col("r"), F.col("k"))).collect()] == ["N12AB", "2125550100", "a@b.com", "Pat O'Neil"]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    chunks = one(spark, text, T.fixed_chunks)
    assert [c.start for c in chunks] == [0, 680, 1360] and all(text[c.start : c.start + 800] == c.chunk for c in chunks)
    assert one(spark, "", T.fixed_chunks) == [] and one(spark, None, T.fixed_chunks) == []


def test_garbage_and_junk(spark):
    assert one(spark, "b6 b7c 12 13", T.ocr_garbage) is True
    assert one(spark, "This sentence clearly holds several proper words", T.ocr_garbage) is False
    assert one(spark, "short", T.ocr_junk) is True


def test_porter_stemmer():
    words = {"running": "run", "relational": "relat", "caresses": "caress", "ponies": "poni", "hopping": "hop", "happy": "happi", "invoices": "invoic", "invoice": "invoic", "adjustable": "adjust", "controlling": "control"}
    assert {w: T.porter_stem(w) for w in words} == words


def test_dates(spark):
    assert str(one(spark, "March 5, 2020", D.timeline_date)) == "2020-03-05"
    assert one(spark, "2020-13-45", D.timeline_date) is None
    assert str(one(spark, "about 1999 or so", D.claim_date)) == "1999-01-01"
    assert one(spark, "on 3/4/39 and", D.text_date) == "2039-03-04"
    m = one(spark, "Seen 2020-02-03, then January 5, 2019.", D.date_mentions)
    assert [x.date for x in m] == ["2019-01-05", "2020-02-03"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    g = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g int, v array<double>")
    assert V.centroid(g, ["g"], "v").first().v == [2.0, 4.0]


def test_snippet_is_escaped(spark):
    assert one(spark, "a <b> Data Broker & co", lambda c: T.like_snippet(c, "data broker")) == "a &lt;b&gt; <mark>Data Broker</mark> &amp; co"
