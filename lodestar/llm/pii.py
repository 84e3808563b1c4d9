"""Information-theoretic sanitisation of personal data (operator 9).  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, id_and_text, small_enough, written

KINDS = ("email", "ip", "card", "phone", "term")
#: For each base kind: the characters that cannot stand right before a match (it would have begun
#: earlier), the match, and a cheap test that a text may hold one.  Possessive where what follows
#: can't match what is given back, so that long runs of a class are read once.
PATTERNS = {
    "email": (r"[^A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"[^0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[^0-9]", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": ("", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
TERM = r"\p{L}++"

CHUNK = 256  # code points of the pieces that texts with matches are cut to
REACH = 60  # characters to either side of an entity within which one text is evidence
PRIOR = 3.0  # texts' worth of doubt in how often a term brings an entity with it
GENERALISE, REMOVE = 0.6, 0.85  # shares of an entity's information that a term may reveal


def _stepped(kind: str) -> str:
    """Matches a gap, lazily, and then the kind; from the end of the last match on (\\G), so that a
    text is read once even where nothing matches."""
    before, match, _ = PATTERNS[kind]
    gap = f"|.*?{before}" if before else ".*?"
    return rf"(?s)\G({gap})({match})"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(v)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table row, doc_id, text: rows get a number that stays."""
    src = id_and_text(docs, id_col, text_col)
    return written(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "pii-texts")


def find_base(src: DataFrame) -> DataFrame:
    """A written table row, kind, nr, start, end, value: a row for each match in numbered texts, in code points; nr
    orders them as the kinds are listed, then by place.

    A text's matches become rows with what stands between them, and a running sum of the lengths tells
    where each ends."""
    found = []
    for at, (kind, (_, _, test)) in enumerate(PATTERNS.items()):
        may = F.col("text").contains(test) if kind == "email" else F.col("text").rlike(test)
        pieces = F.transform(F.regexp_extract_all("text", F.lit(_stepped(kind)), F.lit(0)), F.length)
        both = F.arrays_zip(pieces.alias("n"), F.regexp_extract_all("text", F.lit(_stepped(kind)), F.lit(2)).alias("value"))
        own = F.transform(both, lambda x, i: F.struct((F.lit(at << 32).cast("long") + i).alias("nr"), F.lit(kind).alias("kind"), x["n"].alias("n"), x["value"].alias("value")))  # noqa: B023
        found.append(F.when(may, own).otherwise(F.array().cast("array<struct<nr:bigint,kind:string,n:int,value:string>>")))
    each = written(src.select("row", F.explode(F.concat(*found)).alias("x")).select("row", "x.*"), "pii-raw")
    end = F.sum("n").over(Window.partitionBy("row", "kind").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    passes = F.lit(False)
    for kind in PATTERNS:
        passes = F.when(F.col("kind") == kind, _passes(kind, F.col("value"))).otherwise(passes)
    ended = each.withColumn("end", end).filter(passes)
    out = written(ended.select("row", "kind", "nr", (F.col("end") - F.length("value")).alias("start"), "end", "value"), "pii-base")
    forget(each)
    return out


def _of(src: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of ``src`` that ``rows`` names: up to a million numbers are broadcast, so that texts stay where they
    are; more are joined by a shuffle."""
    names = written(rows.select("row").distinct(), "pii-named")
    return src.join(F.broadcast(names) if small_enough(names, 1_000_000) else names, "row", "left_semi")


def chunked(src: DataFrame, base: DataFrame) -> DataFrame:
    """A written table row, chunk, piece, padded, lead, length: the texts that ``base`` has matches of, cut to
    pieces of CHUNK code points; padded: with REACH of the neighbours', of which lead stand ahead.  What
    lies around a place is found in one piece, without counting from the text's beginning."""
    texts = _of(src, base)
    cut = texts.select("row", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("pieces"), F.length("text").alias("length"))
    cut = written(cut, "pii-pieces")
    around = lambda p, i: F.concat(F.right(F.coalesce(F.get("pieces", i - 1), F.lit("")), F.lit(REACH)), p, F.left(F.coalesce(F.get("pieces", i + 1), F.lit("")), F.lit(REACH)))
    both = F.transform("pieces", lambda p, i: F.struct(p.alias("piece"), around(p, i).alias("padded")))
    out = cut.select("row", "length", F.posexplode(both).alias("chunk", "x"))
    out = written(out.select("row", "chunk", "x.piece", "x.padded", F.when(F.col("chunk") > 0, REACH).otherwise(0).alias("lead"), "length"), "pii-chunks")
    forget(cut)
    return out


def entities(base: DataFrame, chunks: DataFrame) -> DataFrame:
    """row, entity, near: the entities of each text, e-mail addresses lower-cased, separators of numbers left
    out; near: what stands within REACH of it, without words that the edge or the entity touches."""
    name = F.concat("kind", F.lit(":"), F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.regexp_replace("value", r"[\x20()-]", "")))
    at = lambda c: F.floor(F.col(c) / CHUNK).cast("int")
    e = base.select("row", name.alias("entity"), "start", "end", at("start").alias("l"), at("end").alias("r"))
    of = lambda n: chunks.select("row", F.col("chunk").alias(n), F.col("padded").alias(f"{n}_text"), F.col("lead").alias(f"{n}_lead"), *(["length"] if n == "l" else []))
    e = e.join(of("l"), ["row", "l"]).join(of("r"), ["row", "r"], "left")
    n = F.least(F.col("start"), F.lit(REACH))
    left = F.regexp_replace(F.substr("l_text", F.col("l_lead") + F.col("start") - F.col("l") * CHUNK - n + 1, n), r"\p{L}+$", "")
    left = F.when(F.col("start") > REACH, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.coalesce(F.substr("r_text", F.col("r_lead") + F.col("end") - F.col("r") * CHUNK + 1, F.lit(REACH)), F.lit(""))
    right = F.regexp_replace(right, r"^\p{L}+", "")
    right = F.when(F.col("length") > F.col("end") + REACH, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return e.select("row", "entity", F.concat(left, F.lit(" "), right).alias("near"))


def _terms(text: str) -> Column:
    """The distinct words of a text, lower-cased one by one."""
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def disclosure(c_et, c_t, c_e, n, near) -> Column:
    """The share of an entity's information, log2(n / c_e), that a term reveals: pointwise mutual
    information with the chance that the term brings the entity smoothed towards none at all by PRIOR
    texts.  Within REACH one text is evidence; elsewhere in a text one more must bear it out."""
    seen = F.when(near, c_et).otherwise(c_et - 1)
    chance = (seen + PRIOR * c_e / n) / (c_t + PRIOR)
    own = F.log2(n / c_e)
    return F.when((seen > 0) & (own > 0), F.log2(chance * n / c_e) / own).otherwise(0.0)


def revealing(src: DataFrame, base: DataFrame, chunks: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """row, term, d: a written table of the terms of each text that reveal an entity of that text to
    ``generalise`` or more of its information.

    Everything is counted in distinct texts: those that hold the term, the entity, both.  Terms next to
    an entity are paired with it as they stand.  Terms anywhere else in a text are paired with its
    entities only if both occur in two texts or more, and if the term is rare enough to reach the
    threshold were it always to come with the entity; the rest of the pairs can't matter."""
    first = written(src.select("row", F.xxhash64("text").alias("th")).groupBy("th").agg(F.min("row").alias("row")).select("row"), "pii-first")
    n = F.lit(float(max(1, first.count())))
    copies = written(src.select("row").join(first, "row", "left_anti").withColumn("copy", F.lit(True)), "pii-copies")
    small = small_enough(copies, 1_000_000)
    hint = F.broadcast if small else lambda df: df
    once = src.join(hint(copies), "row", "left_anti")
    found = written(entities(base, chunks).join(hint(copies), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(False))), "pii-entities")
    held = found.select("row", "entity", "copy").distinct()
    c_e = written(held.filter("NOT copy").groupBy("entity").agg(F.count("*").alias("c_e")), "pii-entity-counts")
    c_t = once.select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("c_t"))
    words = written(_of(src, base).select("row", F.explode(_terms("text")).alias("term")), "pii-words")
    c_t = written(c_t.join(words.select("term").distinct(), "term"), "pii-term-counts")
    near = found.select("row", "entity", "copy", F.explode(_terms("near")).alias("term")).distinct().withColumn("near", F.lit(True))
    far = held.join(c_e.filter("c_e > 1"), "entity").join(words.join(c_t.filter("c_t > 1"), "term"), "row")
    far = far.filter(F.col("c_t") <= (F.col("c_e") + PRIOR) * F.pow(n / F.col("c_e"), F.lit(1 - generalise)))
    pairs = near.unionByName(far.select("row", "entity", "copy", "term", F.lit(False).alias("near")))
    pairs = written(pairs.groupBy("row", "entity", "term").agg(F.max("near").alias("near"), F.max("copy").alias("copy")), "pii-pairs")
    joint = pairs.filter("NOT copy").groupBy("entity", "term").agg(F.count("*").alias("c_et"), F.max("near").alias("near"))
    rated = joint.join(c_e, "entity").join(c_t, "term").select("entity", "term", disclosure(F.col("c_et"), F.col("c_t"), F.col("c_e"), n, F.col("near")).alias("d"))
    rated = written(rated.filter(F.col("d") >= generalise), "pii-rated")
    out = written(pairs.join(rated, ["entity", "term"]).groupBy("row", "term").agg(F.max("d").alias("d")), "pii-revealing")
    forget(first, copies, found, c_e, c_t, words, pairs, rated)
    return out


def occurrences(src: DataFrame, rated: DataFrame) -> DataFrame:
    """row, start, end, word, d: every occurrence of a row's rated terms in its text."""
    texts = _of(src.select("row", "text"), rated)
    stepped = F.lit(rf"(?s)\G(|.*?\P{{L}})({TERM})")
    both = F.arrays_zip(F.transform(F.regexp_extract_all("text", stepped, F.lit(0)), F.length).alias("all"), F.regexp_extract_all("text", stepped, F.lit(2)).alias("word"))
    each = texts.select("row", F.posexplode(both).alias("nr", "x")).select("row", "nr", "x.all", "x.word")
    end = F.sum("all").over(Window.partitionBy("row").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end.cast("int")).select("row", (F.col("end") - F.length("word")).alias("start"), "end", "word", F.lower("word").alias("term"))
    return each.join(rated, ["row", "term"]).select("row", "start", "end", "word", "d")


def _class(word: Column) -> Column:
    """What a word is generalised to: the class its letters show."""
    return F.when(word.rlike(r"^\p{Lu}{2,}$"), "[ACRONYM]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, base, terms, text: one row for each row of docs.  base: kind, start, end, value of the
    personal data found by pattern; terms: start, end, action, tag of the words that reveal it.

    How strongly a term reveals an entity is estimated from the corpus (:func:`revealing`); terms from
    ``generalise`` on are replaced by their class, from ``remove`` on left out, wherever they occur in a
    text that holds the entity.  ``text`` has entities replaced by their kind and this done; it is null
    where nothing was found.  A null text is empty; copies of a text don't add evidence and are all
    treated alike; repeated rows and null ids are kept as they are; a text of any length is read whole, in time that
    grows with its length and its matches; an empty table gives no rows."""
    src = numbered(docs, id_col, text_col)
    base = find_base(src)
    chunks = chunked(src, base)
    rated = revealing(src, base, chunks, generalise)
    found = occurrences(src, rated)
    tag = F.when(F.col("d") >= remove, "").otherwise(_class(F.col("word")))
    action = F.when(F.col("d") >= remove, "remove").otherwise("generalise")
    own = base.select("row", "start", "end", F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("tag"), F.lit(None).cast("string").alias("action"))
    spans = own.unionByName(found.select("row", "start", "end", tag.alias("tag"), action.alias("action")))
    spans = written(_apart_from_base(spans), "pii-spans")
    terms = spans.filter("action IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action", "tag"))).alias("terms"))
    matches = F.transform(F.array_sort(F.collect_list(F.struct("nr", "kind", "start", "end", "value"))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    made = base.groupBy("row").agg(matches.alias("base")).join(terms, "row", "left").join(_cleaned(chunks, spans), "row", "left")
    made = written(made, "pii-made")
    forget(base, chunks, rated, spans)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = src.select("row", "doc_id").join(made, "row", "left")
    return out.select("doc_id", none("base", "array<struct<kind:string,start:int,end:int,value:string>>"), none("terms", "array<struct<start:int,end:int,action:string,tag:string>>"), "text")


def _apart_from_base(spans: DataFrame) -> DataFrame:
    """``spans`` (row, start, end, tag, action) without terms that overlap matches (action null): of those that begin no
    later than a term the greatest end, and of the others the least beginning, tell."""
    own = F.col("action").isNull()
    upto = Window.partitionBy("row").orderBy("start", own.desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("row").orderBy(F.col("start").desc(), own.asc()).rowsBetween(Window.unboundedPreceding, 0)
    s = spans.withColumns({"reached": F.max(F.when(own, F.col("end"))).over(upto), "next": F.min(F.when(own, F.col("start"))).over(beyond)})
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return s.filter(own | apart).drop("reached", "next")


def _cleaned(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """row, text: the texts with each span's tag in its place.  Of spans that overlap the first one's tag stands, and
    what the others cover goes with it.

    Spans are merged to regions by a running maximum of their ends, regions are dealt to the pieces of text that
    they touch, and each piece is made anew alone; then pieces are joined in order."""
    order = Window.partitionBy("row").orderBy("start", "end", "tag")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)))
    s = s.withColumn("region", F.count_if("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regions = s.groupBy("row", "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("fresh"), F.col("tag"))).alias("tag"))
    touched = F.sequence(F.floor(F.col("start") / CHUNK).cast("int"), F.floor((F.col("end") - 1) / CHUNK).cast("int"))
    dealt = regions.withColumn("chunk", F.explode(touched))
    base = F.col("chunk") * CHUNK
    here = F.struct(F.greatest(F.col("start") - base, F.lit(0)).alias("from"), F.least(F.col("end") - base, F.lit(CHUNK)).alias("to"), F.when(F.col("start") >= base, F.col("tag")).otherwise("").alias("tag"))
    cuts = dealt.withColumn("cut", here).groupBy("row", "chunk").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, c: F.struct(c["to"].alias("at"), F.concat(s["out"], F.substr("piece", s["at"] + 1, c["from"] - s["at"]), c["tag"]).alias("out"))
    made = F.aggregate("cuts", zero, step, lambda s: F.concat(s["out"], F.substr("piece", s["at"] + 1, F.lit(CHUNK))))
    pieces = chunks.select("row", "chunk", "piece").join(cuts, ["row", "chunk"], "left").select("row", F.struct("chunk", F.when(F.col("cuts").isNull(), F.col("piece")).otherwise(made).alias("piece")).alias("x"))
    return pieces.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: the spans, and the sanitised text where there is any (null elsewhere);
    nulls, repeated rows and empty tables as in :func:`sanitise`."""
    found = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", name)
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"), F.col("text").alias("sanitised"))
