"""Reading a page of words: date tokens, labels, their binding, and the ladder of outcomes.

A page is one row: doc_id, width, height, convention and tokens, an array of
(text, line, box, confidence) in reading order.  All steps are Columns over that array,
so that a page never leaves its row and nothing is shuffled; a page's words are bounded by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridate.functions import labels, machine, sql, text, tokens
from veridate.operators import layout

#: Words of a date at most, text heights to a next line, base confidences, bonus of agreement, ceiling, and the word confidence of handwriting.
DATE_WORDS, NEXT_LINE, LABEL_BASE, CODE_BASE, AGREED, CEILING, LOW_WORDS = 7, 2.0, 0.82, 0.88, 0.04, 0.9, 65
SOUGHT = ["EXPIRY", "STATEMENT_PERIOD_END"]
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TOKENS = f"array<struct<text:string,line:int,box:{BOX},confidence:double>>"

def union_box(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """Shares of the page between 0 and 1; null for an empty page."""
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when((width > 0) & (height > 0), F.array(inside(box["x0"] / width), inside(box["y0"] / height), inside(box["x1"] / width), inside(box["y1"] / height)))


def continues_sql(a: str, b: str) -> str:
    """Whether box b can be the next line of box a."""
    h, gap = layout.height_sql(a), f"({b}.y0 - {a}.y1)"
    return f"{gap} >= -0.5D * {h} and {gap} <= {NEXT_LINE}D * {h} and {layout.across_sql(a, b)}"


def _widest(found: str, most: int, better: str) -> str:
    """SQL of the best window of up to `most` words from place i on, or null; found: SQL of a window of members m, w words wide, as a struct that starts with `better` and width, or null.

    j says of each word whether it continues the one before it.
    """
    goes = sql.let("z", f"slice(j, i + 2, {most - 1})", "if(array_position(z, false) > 0, int(array_position(z, false)), size(z) + 1)")
    return f"array_max(filter(transform(sequence(1, {goes}), w -> {sql.let('m', 'slice(p.words, i + 1, w)', found)}), o -> o is not null))"


def _greedy(found: str, most: int, kind: str, joined: str, skip: str = "false") -> str:
    """SQL of the best windows of up to `most` words from each place of p.words on, in order, none over another.

    joined: whether word x (at place i, from 1 on) continues word y before it; skip: whether no window starts at place i.
    """
    step = sql.let("b", f"if(i < s.next or {skip}, null, {_widest(found, most, kind)})", "named_struct('next', if(b is null, s.next, i + b.width), 'all', if(b is null, s.all, concat(s.all, array(b))))")
    places = "if(size(p.words) > 0, sequence(0, size(p.words) - 1), cast(array() as array<int>))"
    walk = f"aggregate({places}, named_struct('next', 0, 'all', cast(array() as array<{kind}>)), (s, i) -> {step}, s -> s.all)"
    return sql.let("j", f"transform(p.words, (x, i) -> i > 0 and {sql.let('y', 'p.words[greatest(i - 1, 0)]', joined)})", walk)


_BOX = "named_struct('x0', array_min(m.box.x0), 'y0', array_min(m.box.y0), 'x1', array_max(m.box.x1), 'y1', array_max(m.box.y1))"
_SPAN = f"w as width, i as start, raw, {_BOX} as box, array_min(m.confidence) as confidence, m[0].line as line"
_SPAN_TYPE = f"width:int,start:int,raw:string,box:{BOX},confidence:double,line:int"
_DATE = f"struct<strength:int,{_SPAN_TYPE},crosses:boolean>"
_LABEL = f"struct<score:double,{_SPAN_TYPE},role:string,code:boolean,bare:boolean>"


def date_tokens(words: Column, convention: Column, as_of: Column) -> Column:
    """Array of date tokens: windows of up to seven words, also over a line's end, that read as a date; more parts win, then more words."""
    reads = tokens.reading_sql("raw", f"n = {tokens.RANGE_STRENGTH}", "p.convention", "'EXPIRY'", "p.as_of")
    token = f"if({reads} is null, null, struct(n as strength, {_SPAN}, exists(m, v -> v.line <> m[0].line) as crosses))"
    # No date without a digit: most windows are done after one look.
    found = sql.let("raw", text.join_sql("m.text"), f"if(raw rlike '[0-9]', {sql.let('n', tokens.strength_sql('raw'), f'if(n > 0, {token}, null)')}, null)")
    joined = f"(x.line = y.line or x.line = y.line + 1 and {continues_sql('y.box', 'x.box')})"
    return sql.bind(_greedy(found, DATE_WORDS, _DATE, joined), words=words, convention=convention, as_of=as_of)


def label_hits(words: Column) -> Column:
    """Array of lexicon labels on the page, within lines, not after a word that makes their date one to come; bare codes need the layout of a licence card."""
    forms = F.transform(words, lambda w: text.label_form(w["text"]))
    bare = f"(e.code and e.canonical rlike '{labels.BARE}')"
    hit = f"if(e is null or {bare} and not exists(p.forms, v -> v in ({sql.names(labels.LAYOUT_CODES)})), null, struct(e.score, {_SPAN}, e.role, e.code, {bare} as bare))"
    # The label form of joined words is that of their forms joined, without blanks for words of marks alone.
    form = "array_join(filter(slice(p.forms, i + 1, w), v -> v <> ''), ' ')"
    found = sql.let("raw", "array_join(m.text, ' ')", sql.let("f", form, sql.let("e", labels.match_sql("f"), hit)))
    forward = f"(i > 0 and j[i] and p.forms[greatest(i - 1, 0)] in ({sql.names(labels.FORWARD)}))"
    return sql.bind(_greedy(found, labels.MOST_WORDS, _LABEL, "x.line = y.line", forward), words=words, forms=forms)


def followed_by_sentinel(words: Column, label: Column) -> Column:
    """Whether one to three words after a label, on its line, say that there is no date."""
    start = label["start"] + label["width"]

    def says(n: Column) -> Column:
        own = F.slice(words, start + 1, n)
        return (F.size(own) == n) & F.forall(own, lambda w: w["line"] == label["line"]) & text.is_sentinel(F.array_join(F.transform(own, lambda w: w["text"]), " "))

    return F.exists(F.sequence(F.lit(1), F.lit(3)), says)


def bindings(found: Column, values: Column, convention: Column, as_of: Column) -> Column:
    """For each label the nearest admissible date, as (label, token, distance, bound, relation, iso, ambiguous); nearer first, then surer words."""
    read = tokens.reading_sql("v.raw", f"v.strength = {tokens.RANGE_STRENGTH}", "p.convention", "l.role", "p.as_of")
    bound = "struct(o.distance / o.bound as far, -v.confidence as unsure, -l.score as unlike, v.start as at, l as label, v as token, o.distance, o.bound, o.relation, r.iso, r.ambiguous)"
    weighed = sql.let("o", f"if(v.start = l.start, null, {layout.place_sql('l.box', 'v.box')})", f"if(o is null, null, {sql.let('r', read, f'if(r is null, null, {bound})')})")
    return sql.bind(f"transform(p.labels, l -> array_min(filter(transform(p.dates, v -> {weighed}), b -> b is not null)))", labels=found, dates=values, convention=convention, as_of=as_of)


def candidate_confidence(b: Column, agreed: Column) -> Column:
    raw = F.when(b["label"]["code"], CODE_BASE).otherwise(LABEL_BASE) * b["label"]["score"] * F.least(b["label"]["confidence"], b["token"]["confidence"]) / 100 * (1 - 0.15 * b["distance"] / b["bound"]) + F.when(agreed, AGREED).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(CEILING))


def _candidate(b: Column, agreed: Column, width: Column, height: Column) -> Column:
    return F.struct(b["token"]["raw"].alias("raw"), b["iso"].alias("iso"), b["label"]["role"].alias("role"), b["label"]["raw"].alias("label"), F.concat_ws(" ", b["label"]["raw"], b["token"]["raw"]).alias("snippet"), normal_box(union_box(b["label"]["box"], b["token"]["box"]), width, height).alias("bbox"), F.round(candidate_confidence(b, agreed), 6).alias("confidence"), b["relation"].alias("relation"), b["token"]["crosses"].alias("crosses"))


def read_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages with reason (null: candidates were found) or else codes, and candidates: the sought date first, then one of each other role."""
    c = F.col
    words = c("tokens")
    letters = F.array_join(F.transform(words, lambda w: w["text"]), "")
    p = pages.withColumns({"latin": text.latin_letters(letters), "other": text.other_letters(letters), "dates": date_tokens(words, c("convention"), as_of), "labels": label_hits(words)})
    sought = lambda x: x["role"].isin(SOUGHT)
    p = p.withColumns({"sought": F.filter("labels", sought), "denied": F.filter("labels", lambda x: sought(x) & followed_by_sentinel(words, x))})
    asking = F.filter("labels", lambda x: ~F.exists("denied", lambda d: d["start"] == x["start"]))
    # A bare code is trusted only beside a whole date.
    trusted = lambda b: b.isNotNull() & (~b["label"]["bare"] | (b["relation"] == "RIGHT") & (b["token"]["strength"] >= 3))
    p = p.withColumn("bound", F.filter(bindings(asking, c("dates"), c("convention"), as_of), trusted))
    p = p.withColumn("ends", F.array_sort(F.filter("bound", lambda b: b["label"]["role"].isin(SOUGHT))))
    isos = F.array_distinct(F.filter(F.transform("ends", lambda b: b["iso"]), lambda d: d.isNotNull()))
    reason = (
        F.when(F.size(words) == 0, "NO_DATES_FOUND")
        .when(text.unsupported_script(c("latin"), c("other")), "UNSUPPORTED_SCRIPT")
        .when(F.size("labels") == 0, F.when(F.size("dates") == 0, "NO_DATES_FOUND").otherwise("NO_EXPIRY_SEMANTICS"))
        .when(F.exists("ends", lambda b: b["ambiguous"]), "AMBIGUOUS_DATE_FORMAT")
        .when(F.size(isos) > 1, "MULTIPLE_EXPIRY_CANDIDATES")
        .when(F.size(isos) == 0, "NO_EXPIRY_SEMANTICS")
    )
    detail = (
        F.when(F.size("denied") > 0, F.concat(F.lit("declared without expiry: "), c("denied")[0]["raw"]))
        .when(F.size("sought") == 0, "no label of an expiry")
        .when(F.size("bound") < F.size("sought"), "no date within reach of a label")
    )
    p = p.withColumns({"reason": reason, "detail": F.when(reason == "NO_EXPIRY_SEMANTICS", detail)})
    agreed = F.size("ends") > 1
    others = F.array_sort(F.filter("bound", lambda b: b["label"]["role"] != "EXPIRY"))
    once = F.filter(others, lambda b, i: ~F.exists(F.slice(others, 1, i), lambda o: o["label"]["role"] == b["label"]["role"]))
    best = _candidate(F.get("ends", F.lit(0)), agreed, c("width"), c("height"))
    rest = F.transform(once, lambda b: _candidate(b, F.lit(False), c("width"), c("height")))
    found = F.when(c("reason").isNull(), F.concat(F.array(best), rest))
    low = F.least(F.get("ends", F.lit(0))["label"]["confidence"], F.get("ends", F.lit(0))["token"]["confidence"]) < LOW_WORDS
    codes = F.when(c("reason").isNotNull(), F.array("reason")).when(low, F.array(F.lit("LOW_TIER_CONFIDENCE"))).otherwise(F.array().cast("array<string>"))
    return p.withColumns({"candidates": found, "codes": codes}).drop("latin", "other", "dates", "labels", "sought", "denied", "bound", "ends")


def lines(words: DataFrame) -> DataFrame:
    """Lines of pages from words (doc_id, word_ord, text, box, width, height) without line numbers: words by their middle, a new line where one overlaps the line so far by less than a third.

    (doc_id, line_ord, text, bbox); one shuffle by page.
    """
    own = F.struct(((F.col("box.y0") + F.col("box.y1")) / 2).alias("middle"), F.col("box.x0").alias("x0"), F.col("word_ord").alias("word_ord"), F.col("text").alias("text"), F.col("box").cast(BOX).alias("box"))
    pages = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("words"), F.max("width").alias("width"), F.max("height").alias("height"))
    row = f"struct<box:{BOX},words:array<struct<x0:double,word_ord:int,text:string>>>"
    word = lambda w: F.struct(w["x0"].alias("x0"), w["word_ord"].cast("int").alias("word_ord"), w["text"].alias("text"))

    def put(rows: Column, w: Column) -> Column:
        last = F.try_element_at(rows, F.lit(-1))
        joins = last.isNotNull() & (layout.vertical_overlap(last["box"], w["box"]) >= layout.OVERLAP)
        grown = F.struct(union_box(last["box"], w["box"]).alias("box"), F.concat(last["words"], F.array(word(w))).alias("words")).cast(row)
        return F.when(joins, F.concat(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(rows, F.array(F.struct(w["box"].alias("box"), F.array(word(w)).alias("words")).cast(row))))

    rows = F.aggregate("words", F.array().cast(f"array<{row}>"), put)
    found = pages.select("doc_id", "width", "height", F.posexplode(rows).alias("line_ord", "r"))
    return found.select("doc_id", "line_ord", F.array_join(F.transform(F.array_sort("r.words"), lambda w: w["text"]), " ").alias("text"), normal_box(F.col("r.box"), F.col("width"), F.col("height")).alias("bbox"))


#: Least share of a zone's alphabet in a line, and how far the area reaches beyond its lines and above them.
ZONE_ALPHABET, ZONE_PAD, ZONE_ABOVE = 0.93, 0.03, 0.55


def zone_area(found: DataFrame) -> DataFrame:
    """(doc_id, area) where a machine-readable zone may stand, from lines (doc_id, text, bbox): around all lines of a zone's length and alphabet."""
    bare = F.regexp_replace("text", r"\s", "")
    zone = found.where(F.col("bbox").isNotNull() & F.length(bare).isin([n for _, n, _ in machine.LAYOUTS]) & (machine.alphabet_ratio(F.col("text")) >= ZONE_ALPHABET))
    side = lambda i, how: how(F.get("bbox", F.lit(i)))
    low, high = lambda v: F.greatest(F.lit(0.0), v), lambda v: F.least(F.lit(1.0), v)
    area = F.array(low(side(0, F.min) - ZONE_PAD), low(side(1, F.min) - ZONE_ABOVE), high(side(2, F.max) + ZONE_PAD), high(side(3, F.max) + ZONE_PAD))
    return zone.groupBy("doc_id").agg(area.alias("area"))
