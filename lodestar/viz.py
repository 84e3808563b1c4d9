"""HTML reports of bundles."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators.shards import greedy_spans

NO_TEXT = '<p class="viz-empty">Document text not provided for this document.</p>'
NOTHING = '<li class="viz-empty">No extractions for this filter.</li>'


def highlights(text, spans) -> Column:
    """A document's text with its marked spans.  spans: sorted struct(char_start, char_end, cls);
    those out of bounds or beginning within one already marked are left out."""
    text, spans = F.col(text), F.col(spans)
    fit = F.filter(spans, lambda s: (s["char_start"] >= 0) & (s["char_end"] >= s["char_start"]) & (s["char_end"] <= F.length(text)))
    kept = greedy_spans(fit)
    cut = lambda a, b: T.escape_html(F.substr(text, a + 1, b - a))

    def mark(s):
        return F.concat(F.lit('<mark class="viz-mark" data-start="'), s["char_start"].cast("string"), F.lit('" data-end="'), s["char_end"].cast("string"), F.lit('" data-class="'), T.escape_html(s["cls"]), F.lit('">'), cut(s["char_start"], s["char_end"]), F.lit("</mark>"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(kept, zero, lambda s, x: F.struct(x["char_end"].alias("at"), F.concat(s["out"], cut(s["at"], x["char_start"]), mark(x)).alias("out")), lambda s: F.concat(s["out"], cut(s["at"], F.length(text))))
    return F.when(F.coalesce(text, F.lit("")) == "", NO_TEXT).otherwise(F.concat(F.lit('<pre class="viz-document">'), body, F.lit("</pre>")))


def extraction_list(spans) -> Column:
    """List items of sorted struct(char_start, char_end, cls, quote)."""
    spans = F.col(spans)
    item = lambda s: F.concat(F.lit('<li data-class="'), T.escape_html(s["cls"]), F.lit('"><strong>'), T.escape_html(s["cls"]), F.lit("</strong> ["), s["char_start"].cast("string"), F.lit(", "), s["char_end"].cast("string"), F.lit(") <code>"), T.escape_html(s["quote"]), F.lit("</code></li>"))
    return F.when(F.size(spans) == 0, NOTHING).otherwise(F.array_join(F.transform(spans, item), ""))


def sections(extractions: DataFrame, documents: DataFrame, filter_class: str = "all") -> DataFrame:
    """document_id, html: a section for each document (document_id, text) from its extractions.
    Those of one place keep the order of column ``nth``."""
    scoped = extractions if filter_class == "all" else extractions.filter(F.col("extraction_class") == filter_class)
    spans = scoped.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "nth", "char_end", F.col("extraction_class").alias("cls"), "quote"))).alias("spans"))
    d = documents.join(spans, "document_id", "left")
    d = d.withColumn("spans", F.coalesce("spans", F.array().cast(d.schema["spans"].dataType)))
    name = T.escape_html(F.col("document_id"))
    return d.select("document_id", F.concat(F.lit('<section class="viz-bundle" data-document-id="'), name, F.lit('"><h2>'), name, F.lit("</h2>"), highlights("text", "spans"), F.lit('<ul class="viz-list">'), extraction_list("spans"), F.lit("</ul></section>")).alias("html"))


_PAGE = """<!doctype html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>%(title)s</title>
<style>body{font:15px/1.5 sans-serif;margin:2rem}.viz-document{white-space:pre-wrap}.viz-mark{background:#ffe58a}.viz-bundle[hidden]{display:none}</style>
</head>
<body>
<h1>%(title)s</h1>
<label>Class <select id="viz-filter">%(options)s</select></label>
<main id="viz-bundles">
%(sections)s
</main>
<script type="application/json" id="viz-data">%(data)s</script>
<script>
const pick = document.getElementById("viz-filter");
pick.addEventListener("change", () => {
  for (const el of document.querySelectorAll("mark[data-class],li[data-class]")) {
    el.style.opacity = pick.value === "all" || el.dataset.class === pick.value ? 1 : 0.2;
  }
});
</script>
</body>
</html>
"""


def page(made: DataFrame, classes: list[str], title: str = "Extractions", filter_class: str = "all", data: object = None) -> str:
    """The whole page.  A report is read by a person, so ``made`` (:func:`sections`) should have the
    documents of one report; they are fetched in order of their id."""
    rows = made.orderBy("document_id").toLocalIterator()
    options = "".join(f'<option value="{html.escape(c)}"{" selected" if c == filter_class else ""}>{html.escape(c)}</option>' for c in ["all", *sorted(classes)])
    payload = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")
    return _PAGE % {"title": html.escape(title), "options": options, "sections": "\n".join(r.html for r in rows), "data": payload}


def write_report(made: DataFrame, path: str, classes: list[str], title: str = "Extractions", data: object = None) -> None:
    """The page as a folder of text files: in order of their names they are the page.  Sections are sorted and written by
    as many tasks as they need; nothing is fetched."""
    mark = '<main id="viz-bundles">'
    head, tail = page(made.limit(0), classes, title, data=data).split(mark, 1)
    ends = made.sparkSession.createDataFrame([(0, "", head + mark), (2, "", tail.strip("\n"))], "place int, document_id string, html string")
    rows = made.select(F.lit(1).alias("place"), "document_id", "html").unionByName(ends)
    rows.orderBy("place", "document_id").select("html").write.text(path)


def write_text(df_spark, path: str, content: str) -> None:
    """Writes a text file through Hadoop's file systems, so any path Spark knows will do."""
    jvm = df_spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df_spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
