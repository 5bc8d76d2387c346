"""Columns that are named as helpers were or are: every operator that keeps a table's columns."""

from pyspark.sql import functions as F

from spanforge.llm.html_consensus import extract_main_text
from spanforge.llm.language_mixture import learn, with_language
from spanforge.llm.line_frequency import drop_site_boilerplate
from spanforge.llm.periodic_runs import with_runs
from spanforge.llm.poisson_mix import mix_sources
from spanforge.llm.progressive_jpeg import with_media, with_pictures
from spanforge.llm.shingle_copies import drop_near_copies
from spanforge.llm.simhash import drop_near_duplicates
from spanforge.llm.toxicity import learn_toxicity, with_toxicity

NAMES = "__a __b __id __n __source __cdf __language __host __path __text __own __left __keys __key __hot __picture one two row_id times cdf source_ language host keys owned kept path repeated key text_ found picture LANGUAGE_"


def test_columns_stay(spark):
    names = list(dict.fromkeys(NAMES.split()))
    rows = [(i, f"some words of text number {i // 2} are here " * 3, "en", "s" if i % 3 else None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({n: F.concat(F.lit("kept "), F.lit(n)) for n in names})
    docs = docs.unionByName(docs.where("doc_id = 4"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    results = {
        "language": with_language(docs, learn(docs)),
        "lines": drop_site_boilerplate(docs),
        "mix": mix_sources(docs, size=3.0),
        "simhash": drop_near_duplicates(docs),
        "copies": drop_near_copies(docs),
        "runs": with_runs(docs.drop("runs")),
        "toxicity": with_toxicity(docs, learn_toxicity(docs, labels)),
        "pages": extract_main_text(docs.withColumns({"url": F.lit("http://h.example/"), "html": F.concat(F.lit("<p>"), "text", F.lit("</p>"))})),
        "pictures": with_pictures(with_media(docs.limit(2))),
    }
    for name, df in results.items():
        assert {n.lower() for n in names} <= {c.lower() for c in df.columns}, name
        got = df.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"kept {n}" for n in names)], name
