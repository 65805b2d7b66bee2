"""The ladder of readers: from documents to responses, each reader only for what cheaper ones left open.

Rejection and gate, barcode, page of words and machine-readable zone look at one
document alone, so that they are one pass over `documents` without a shuffle; a reader
gets its input only where the ones before it left the document open (else null, which
costs nothing).  What they found, without pages and payloads, is written once, and so is
the class that follows from it.  Only documents that are still open and admitted in full
are joined with the paid calls, and that result is written too.  Dates of all readers then meet in windows over doc_id, in
order of authority, and every document gets one response.

documents: doc_id, rejected (why the upload was turned away, or null), likeness_negative,
screen_negative, text_layer, barcode (payload or null), tokens (`pages.TOKENS`; null: the
page could not be read), ocr_confidence, width, height, pages, pdf, blur, dpi, clipping,
quality_codes, elapsed_ms.  calls: doc_id, hunter, hunter_label, hunter_snippet,
hunter_ok, mapper (raw, role, illegible, label, snippet), mapper_ok, failures, injected,
kind (the class that the mapper reads), issuer, usd, budget_usd; no row: no model to ask.
doc_id is unique in both.  Nulls stand for what is not known; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridate.functions import dates, labels, machine, sql, text
from veridate.operators import classify, constraints, crosscheck, merge, pages, respond, twocalls, verdict
from veridate.sources.stages import written

#: Milliseconds for a document in all, and those that reading a page and asking models need at least; confidence of a class that a model reads and of a document that has no expiry; word confidence below which reading has failed.
BUDGET_MS, READ_MS, ASK_MS, READ_CLASS, ENDLESS, COLLAPSED = 45_000, 4_000, 9_000, 0.7, 0.92, 40
#: Codes of an image's quality that explain why reading failed.
EXPLAINED = ["IMAGE_TOO_BLURRY", "RESOLUTION_TOO_LOW", "GLARE_OBSCURES_FIELD", "DOCUMENT_CROPPED", "EXTREME_SKEW", "POOR_CONTRAST", "OBSTRUCTED_BY_HAND", "PHOTOCOPY_DEGRADED"]
#: Readers in order of authority.
TIERS = ["TA_PDF417", "TA_MRZ", "TB_OCR", "TC_VLM"]
IDENTITY = ["US_DRIVERS_LICENSE", "US_STATE_ID", "PASSPORT", "NATIONAL_ID_CARD", "RESIDENCE_PERMIT"]
#: Elements of a barcode that hold dates.
ELEMENTS = [("DBA", "EXPIRY", "DBA (document expiration date)"), ("DBD", "ISSUE", "DBD (document issue date)"), ("DBB", "DATE_OF_BIRTH", "DBB (date of birth)")]
SURE = 0.99
CANDIDATE = "struct<raw:string,iso:date,role:string,label:string,snippet:string,confidence:double>"
#: What a reader says of a document.
RESULT = f"struct<tier:string,abstained:boolean,candidates:array<{CANDIDATE}>,codes:array<string>,anomalies:array<string>,checksum:boolean,detail:string,issuer:string,usd:double>"


def _strings(*values: str | Column) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)).cast("array<string>")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def result(tier: str, abstained: Column, candidates: Column, codes: Column, anomalies: Column | None = None, checksum: Column | None = None, detail: Column | None = None, issuer: Column | None = None, usd: Column | None = None) -> Column:
    none = F.array().cast(f"array<{CANDIDATE}>")
    parts = {"tier": F.lit(tier), "abstained": abstained, "candidates": F.when(abstained, none).otherwise(candidates), "codes": codes, "anomalies": _strings() if anomalies is None else anomalies, "checksum": checksum, "detail": detail, "issuer": issuer, "usd": F.lit(0.0) if usd is None else usd}
    kinds = {"checksum": "boolean", "detail": "string", "issuer": "string"}
    return F.struct(*((_null(kinds[n]) if c is None else c).alias(n) for n, c in parts.items())).cast(RESULT)


def first_date(candidates: Column, role: str) -> Column:
    """The date of the first candidate of a role."""
    return F.get(F.filter(candidates, lambda c: c["role"] == role), F.lit(0))["iso"]


def barcode_result(payload: Column, decoded: Column, dpi: Column, as_of: Column) -> Column:
    """What a decoded barcode (machine.aamva_payload, null if it is none of a licence) says; decoded: whether there was a barcode at all."""
    e = payload["elements"]
    country, version, iin = F.try_element_at(e, F.lit("DCG")), payload["version"], payload["iin"]
    issuer = F.coalesce(F.try_element_at(e, F.lit("DAJ")), country)
    read = [(id, role, label, F.try_element_at(e, F.lit(id)), machine.aamva_resolved(F.try_element_at(e, F.lit(id)), country, version)) for id, role, label in ELEMENTS]
    candidates = F.array_compact(F.array(*(F.when(r["iso"].isNotNull(), F.struct(v.alias("raw"), r["iso"].alias("iso"), F.lit(role).alias("role"), F.lit(label).alias("label"), F.concat(F.lit(id), v).alias("snippet"), F.lit(SURE).alias("confidence"))) for id, role, label, v, r in read)))
    conflict = F.when(F.coalesce(*(F.when(r["conflict"], True) for *_, r in read), F.lit(False)), _strings("AMBIGUOUS_DATE_FORMAT")).otherwise(_strings())

    def body(x: Column) -> Column:
        own = {role: first_date(x["candidates"], role) for _, role, _ in ELEMENTS}
        wrong = crosscheck.implausible(own["EXPIRY"], own["ISSUE"], own["DATE_OF_BIRTH"], as_of)
        head = F.concat(F.lit("AAMVA v"), version.cast("string"), F.lit(", IIN "), iin)
        order = F.when(version <= 1, "order resolved per field").when(country == "CAN", "CCYYMMDD").when(country == "USA", "MMDDCCYY").otherwise("order resolved per field")
        told = F.concat(F.lit("error correction passed; "), head, F.lit(", dates read as "), order, F.coalesce(F.concat(F.lit(" (DCG="), country, F.lit(")")), F.lit(" (DCG absent)")))
        none = F.array().cast(f"array<{CANDIDATE}>")
        return (
            F.when(~decoded, result(TIERS[0], F.lit(True), none, F.when(dpi < classify.DPI, _strings("RESOLUTION_TOO_LOW")).otherwise(_strings("NO_MACHINE_READABLE_REGION")), detail=F.lit("no barcode decoded")))
            .when(payload.isNull(), result(TIERS[0], F.lit(True), none, _strings("NO_MACHINE_READABLE_REGION"), detail=F.lit("the barcode is none of a licence: no compliance header")))
            .when(own["EXPIRY"].isNull(), result(TIERS[0], F.lit(True), none, F.when(F.size(x["codes"]) > 0, x["codes"]).otherwise(_strings("NO_DATES_FOUND")), checksum=F.lit(True), detail=F.concat(head, F.lit(": no usable expiration date")), issuer=issuer))
            .otherwise(result(TIERS[0], F.lit(False), x["candidates"], F.concat(x["codes"], wrong), wrong, F.lit(True), told, issuer))
        )

    return dates.let(F.struct(candidates.cast(f"array<{CANDIDATE}>").alias("candidates"), conflict.alias("codes")), body)


def zone_result(band: Column, reports: Column, fields: Column, repair: Column, as_of: Column) -> Column:
    """What a machine-readable zone says: machine.band, its check_reports and zone_fields, and what would mend it."""
    failed = F.filter(reports, lambda r: ~r["valid"])
    line = F.get(band["lines"], F.lit(1))
    candidate = lambda field, role, raw: dates.let(dates.mrz_date(raw, F.lit(role), as_of), lambda d: F.when(d.isNotNull(), F.struct(raw.alias("raw"), d.alias("iso"), F.lit(role).alias("role"), F.lit(f"MRZ {field}").alias("label"), line.alias("snippet"), F.lit(SURE).alias("confidence")).cast(CANDIDATE)))
    found = F.array_compact(F.array(candidate("expirationDate", "EXPIRY", fields["expiry"]), candidate("birthDate", "DATE_OF_BIRTH", fields["birth"])))
    told = F.array_join(F.transform(failed, lambda r: F.concat(r["field"], F.lit(", line "), r["line"].cast("string"), F.lit(" position "), r["position"].cast("string"), F.lit(': found "'), F.coalesce(r["found"], F.lit("?")), F.lit('", expected "'), F.coalesce(r["expected"], F.lit("?")), F.lit('"'))), "; ")
    mended = F.when(repair.isNotNull(), F.concat(told, F.lit(" — every check digit would hold with "), repair, F.lit(": a misread is likelier than a change; flagged, not corrected"))).otherwise(told)

    def body(x: Column) -> Column:
        expiry, birth = first_date(x, "EXPIRY"), first_date(x, "DATE_OF_BIRTH")
        wrong = crosscheck.implausible(expiry, _null("date"), birth, as_of)
        valid = F.concat(band["format"], F.lit(": all "), F.size(reports).cast("string"), F.lit(" check digits valid"))
        return (
            F.when(band.isNull(), result(TIERS[1], F.lit(True), x, _strings("NO_MACHINE_READABLE_REGION"), detail=F.lit("no zone of 3 x 30, 2 x 36 or 2 x 44 characters")))
            .when(F.size(failed) > 0, result(TIERS[1], F.lit(True), x, _strings("CHECKSUM_FAILED"), _strings("CHECKSUM_FAILED"), F.lit(False), mended, fields["issuer"]))
            .when(expiry.isNull(), result(TIERS[1], F.lit(True), x, _strings("NO_DATES_FOUND"), checksum=F.lit(True), detail=F.concat(valid, F.lit(", but the expiry is no date")), issuer=fields["issuer"]))
            .otherwise(result(TIERS[1], F.lit(False), x, wrong, wrong, F.lit(True), valid, fields["issuer"]))
        )

    return dates.let(found, body)


def page_result(failed: Column, reason: Column, candidates: Column, codes: Column, detail: Column) -> Column:
    """What the page of words says: columns of pages.read_pages; failed: whether it could not be read at all."""
    own = F.transform(candidates, lambda c: F.struct(c["raw"], c["iso"], c["role"], c["label"], c["snippet"], c["confidence"]).cast(CANDIDATE))
    none = F.array().cast(f"array<{CANDIDATE}>")
    return F.when(failed, result(TIERS[2], F.lit(True), none, _strings("MODEL_UNAVAILABLE"), detail=F.lit("the page could not be read: nothing to hold other readings against"))).otherwise(result(TIERS[2], reason.isNotNull(), own, codes, detail=detail))


def unexplained_collapse(confidence: Column, codes: Column) -> Column:
    """Whether words were read with next to no confidence though no code of the image's quality explains it; a null confidence explains itself."""
    return F.coalesce((confidence < COLLAPSED) & ~F.arrays_overlap(codes, _strings(*EXPLAINED)), F.lit(False))


def within_time(elapsed_ms: Column, need_ms: int) -> Column:
    return F.coalesce(elapsed_ms, F.lit(0)) + need_ms < BUDGET_MS


def read_locally(documents: DataFrame, as_of: Column) -> DataFrame:
    """One row a document with what three readers (null: not asked) find on it alone, and what its class is judged by."""
    c = F.col
    d = documents.withColumn("words", F.array_join(sql.bind("p.tokens.text", tokens=c("tokens")), " "))
    page_lines = sql.bind("transform(array_distinct(p.tokens.line), l -> array_join(transform(filter(p.tokens, t -> t.line = l), t -> t.text), ' '))", tokens=c("tokens"))
    d = d.withColumns({"seen": c("rejected").isNull(), "payload": machine.aamva_payload(c("barcode")), "page_lines": page_lines, "hit": classify.gate_hit(F.concat_ws("\n", "text_layer", "words"))})
    zoned = F.coalesce(F.exists("page_lines", lambda x: F.length(F.regexp_replace(x, r"\s", "")).isin([n for _, n, _ in machine.LAYOUTS]) & (machine.alphabet_ratio(x) >= pages.ZONE_ALPHABET)), F.lit(False))
    positive = c("payload").isNotNull() | c("hit").isNotNull() | zoned
    d = d.withColumn("admission", F.when(c("seen"), respond.admission(F.coalesce("likeness_negative", F.lit(False)), F.coalesce("screen_negative", F.lit(False)), positive)))
    d = d.withColumn("admitted", F.coalesce(c("admission.decision") != "REJECT", F.lit(False)))
    d = d.withColumn("TA_PDF417", F.when(c("admitted"), barcode_result(c("payload"), c("barcode").isNotNull(), c("dpi"), as_of)))
    # The page is read only where the barcode left the document open, and while there is time.
    d = d.withColumn("read", c("admitted") & c("TA_PDF417.abstained") & within_time(c("elapsed_ms"), READ_MS))
    d = d.withColumns({"paged": c("read") & c("tokens").isNotNull(), "convention": merge.issuer_convention(c("text_layer"), _null("string"))})
    d = pages.read_pages(d.withColumns({"tokens": F.when(c("paged"), c("tokens")), "width_": c("width"), "height_": c("height"), "width": c("width").cast("double"), "height": c("height").cast("double")}), as_of)
    d = d.withColumn("TB_OCR", F.when(c("read"), page_result(~c("paged"), c("reason"), c("candidates"), c("codes"), c("detail"))))
    d = d.withColumn("lines", F.when(c("admitted"), F.when(c("paged"), c("page_lines")).otherwise(F.split("text_layer", "\n"))))
    d = d.withColumn("band", machine.band(c("lines")))
    d = d.withColumns({"reports": machine.check_reports(c("band.format"), c("band.lines")), "fields": machine.zone_fields(c("band.format"), c("band.lines"))})
    repair = F.when(F.exists("reports", lambda r: ~r["valid"]), machine.repair_notes(c("band.format"), c("band.lines")))
    d = d.withColumn("TA_MRZ", F.when(c("lines").isNotNull(), zone_result(c("band"), c("reports"), c("fields"), repair, as_of)))
    sample = F.array_join(F.transform(F.map_entries("payload.elements"), lambda e: F.concat(e["key"], e["value"])), "\n")
    words = F.when(c("paged"), c("words"))
    collapse = c("paged") & unexplained_collapse(c("ocr_confidence"), F.coalesce("quality_codes", _strings()))
    own = F.concat(F.coalesce("quality_codes", _strings()), F.when(collapse, _strings("MIXED_ORIENTATION_SUSPECTED")).otherwise(_strings()))
    printed = F.coalesce("text_layer", F.nullif(words, F.lit("")))
    return d.select("doc_id", "rejected", "admission", "admitted", "read", *TIERS[:3], own.alias("own_codes"), words.alias("words"), F.when(c("admitted"), printed).alias("printed"), c("text_layer").isNotNull().alias("exact"), sample.alias("sample"), c("band.format").alias("format"), c("width_").alias("width"), c("height_").alias("height"), "pages", "pdf", "blur", "dpi", "clipping", "elapsed_ms")


def classed(found: DataFrame, as_of: Column) -> DataFrame:
    """read_locally()'s rows with kind (classify.classify's struct), cross (two machine-read sources held against each other), whether models are to be asked (open), and whether the gate allows it (limited)."""
    c = F.col
    answered = lambda tier: F.coalesce(~F.col(f"{tier}.abstained"), F.lit(False))
    d = found.withColumns({"barcode_ok": answered("TA_PDF417"), "zone_ok": answered("TA_MRZ"), "page_ok": answered("TB_OCR")})
    d = d.withColumns({"zone_format": F.when(c("zone_ok"), c("format")), "zone_issuer": c("TA_MRZ.issuer"), "code_text": F.when(c("barcode_ok"), c("sample"))})
    kind = classify.classify(c("printed"), c("width"), c("height"), c("zone_ok"), c("zone_format"), c("zone_issuer"), c("barcode_ok"), c("code_text"), _null("string"), c("pages"), c("pdf"), c("exact"), c("blur"), c("dpi"), c("clipping"))
    triple = lambda tier: F.struct(*(first_date(c(f"{tier}.candidates"), role).alias(n) for n, role in crosscheck.ROLES.items()))
    d = d.withColumns({"kind": kind, "zone_dates": triple("TA_MRZ"), "code_dates": triple("TA_PDF417")})
    d = d.withColumn("cross", F.when(c("zone_ok") & c("barcode_ok"), crosscheck.cross_check(F.lit("MRZ"), c("zone_dates"), c("code_dates"), as_of)))
    settled = (c("zone_ok") | c("barcode_ok")) & (F.coalesce(F.size("cross.anomalies"), F.lit(0)) == 0)
    own = F.concat("own_codes", F.coalesce("kind.codes", _strings()), F.coalesce("cross.anomalies", _strings()))
    d = d.withColumns({"open": ~settled & ~c("page_ok"), "limited": c("admission.decision") == "ADMIT_LIMITED", "own_codes": own})
    return d.select("doc_id", "admission", *TIERS[:3], "kind", "cross", "open", "limited", "own_codes", "words", "blur", "dpi", "elapsed_ms")


def ask(opened: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """Open documents with TC_VLM (null: no one was asked), the class that the model read, hunter's and mapper's values, and the code of why it was not asked.

    Dates that only the issuer's convention can settle are read again where the model's class gives another convention than the one at hand.
    """
    c = F.col
    d = opened.join(calls.withColumnsRenamed({"kind": "read_kind", "issuer": "read_issuer"}).withColumn("client", F.lit(True)), "doc_id", "left")
    asked = ~c("limited") & c("client").isNotNull() & within_time(c("elapsed_ms"), ASK_MS)
    why = F.when(c("limited"), "NO_DOMAIN_SIGNAL").when(c("client").isNull(), "MODEL_UNAVAILABLE").when(~asked, "TIMEOUT")
    spends = twocalls.within_budget(F.lit(0.0), F.lit(respond.CALLS_USD), c("budget_usd"))
    d = d.withColumns({"asked": asked, "why": why, "spends": asked & spends, "at": merge.issuer_convention(c("kind.issuer"), c("kind.class"))})
    found = twocalls.merge(c("hunter"), c("hunter_ok"), c("mapper"), c("mapper_ok"), c("kind.class"), c("injected"), c("at"), as_of, c("failures"), (c("hunter_label"), c("hunter_snippet")))
    d = d.withColumn("m", F.when(c("spends"), found)).withColumn("read_kind", F.when(c("spends") & c("mapper_ok"), c("read_kind")))
    d = d.withColumn("class", F.when(c("kind.inconclusive") & c("read_kind").isNotNull(), c("read_kind")).otherwise(c("kind.class")))
    d = d.withColumn("now", merge.issuer_convention(c("kind.issuer"), c("class")))
    kept = "'role', cand.role, 'label', cand.label, 'snippet', cand.snippet, 'confidence', cand.confidence)"
    iso = f"if(cand.iso is null and cand.raw <> '', {dates.free_text_sql('cand.raw', 'p.now', 'cand.role', 'p.as_of')}.iso, cand.iso)"
    turned = F.when(c("now").isNotNull() & ~c("now").eqNullSafe(c("at")), c("now")).otherwise(c("at"))
    again = sql.bind(f"transform(p.found, cand -> named_struct('raw', cand.raw, 'iso', {iso}, {kept})", found=c("m.candidates"), now=turned, as_of=as_of)
    capped = result(TIERS[3], F.lit(True), F.array().cast(f"array<{CANDIDATE}>"), _strings("COST_CAP_REACHED"))
    issuer = F.when(c("mapper_ok"), F.nullif(F.trim("read_issuer"), F.lit("")))
    said = result(TIERS[3], c("m.abstained"), again.cast(f"array<{CANDIDATE}>"), c("m.codes"), issuer=issuer, usd=F.coalesce("usd", F.lit(0.0)))
    d = d.withColumn(TIERS[3], F.when(c("spends"), said).when(c("asked"), capped))
    return d.select("doc_id", TIERS[3], "read_kind", "why")


def cross_call_values(candidates: Column) -> Column:
    """Struct (hunter, mapper) of the raw values whose neighbouring text names the call they come from; null if none does."""
    named = lambda who: f"transform(filter(p.cs, c -> contains(c.snippet, '{who}')), c -> c.raw)"
    return sql.bind(sql.let("v", f"named_struct('hunter', {named('hunter')}, 'mapper', {named('mapper')})", "if(size(v.hunter) > 0 or size(v.mapper) > 0, v, null)"), cs=candidates)


def decide(found: DataFrame, as_of: Column) -> DataFrame:
    """Responses of admitted documents from the results of all readers: read_locally() with TC_VLM, read_kind and why."""
    c = F.col
    settled = c("kind.inconclusive") & c("read_kind").isNotNull()
    d = found.withColumns({"class": F.when(settled, c("read_kind")).otherwise(c("kind.class")), "class_confidence": F.when(settled, READ_CLASS).otherwise(c("kind.confidence")), "results": F.array_compact(F.array(*TIERS)), "calls_said": cross_call_values(c("TC_VLM.candidates"))})
    d = d.withColumn("page_digits", F.nullif(c("words"), F.lit("")))
    cands = d.select("doc_id", "class", "page_digits", "calls_said", F.posexplode("results").alias("tier_ord", "r")).select("doc_id", "class", "page_digits", "calls_said", F.array_position(_strings(*TIERS), c("r.tier")).alias("tier_rank"), c("r.tier").alias("tier"), F.posexplode("r.candidates").alias("ord", "x"))
    cands = cands.select("doc_id", "class", "page_digits", "calls_said", "tier", "tier_rank", (c("tier_rank") * 1000 + c("ord")).alias("cand_ord"), F.coalesce("x.raw", c("x.iso").cast("string"), F.lit("")).alias("raw"), "x.iso", F.coalesce("x.role", F.lit("UNKNOWN")).alias("role"), "x.label", "x.snippet")
    says = lambda values: F.exists(values, lambda v: text.same_value(v, F.col("raw")))
    cross = F.when(c("calls_said").isNotNull(), says(c("calls_said.hunter")) & says(c("calls_said.mapper")))
    united = merge.by_authority(cands).withColumns({"identity": c("class").isin(IDENTITY), "recency_validated": c("class").isin(*verdict.RECENT), "cross_call": cross, "grounded": F.when(c("page_digits").isNotNull(), text.grounded(c("raw"), c("page_digits")))})
    scored = constraints.score(constraints.eliminate(united, as_of))
    engine = constraints.outcome(scored, as_of, d.select("doc_id", "class", c("class").isin(IDENTITY).alias("identity"))).drop("class", "identity")
    winner = scored.where("rank = 1").select("doc_id", F.struct("raw", "iso", "label", "snippet", "tier", "grounded").alias("w"))
    listed = F.struct(F.when(c("rank") == 1, 0).when(c("survives"), 1).otherwise(2).alias("group"), F.coalesce("rank", c("cand_ord").cast("int")).alias("place"), c("raw"), c("iso"), c("role"), c("eliminated_by"))
    inventory = scored.where("survives or eliminated_by is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(listed)).alias("dates_found"))
    d = d.join(engine, "doc_id").join(winner, "doc_id", "left").join(inventory, "doc_id", "left")
    first = F.get(F.filter("results", lambda r: ~r["abstained"]), F.lit(0))["tier"]
    d = d.withColumn("tier", F.coalesce("w.tier", first, F.lit("NONE"))).withColumn("own", F.get(F.filter("results", lambda r: r["tier"] == F.col("tier")), F.lit(0)))
    gathered = lambda field: F.flatten(F.transform("results", lambda r: r[field]))
    notes = F.array_join(F.transform(gathered("candidates"), lambda x: F.coalesce(x["label"], x["snippet"])), "\n")
    card = F.when((c("class") == "MEDICAL_INSURANCE_CARD") & c("w").isNull(), c("words"))
    d = d.withColumn("endless", labels.declares_no_expiry(F.concat_ws("\n", notes, card)))
    d = d.withColumns({
        "anomalies": F.array_distinct(F.concat(F.coalesce("cross.anomalies", _strings()), "anomalies", gathered("anomalies"))),
        "reason_codes": F.concat("own_codes", F.array_compact(_strings(c("why"))), "reason_codes", gathered("codes")),
        "checksum": c("own.checksum"), "cross_source": F.when(c("cross").isNotNull(), ~c("cross.force_review")), "cross_call_ok": twocalls.agreed(c("w.raw"), c("calls_said.hunter"), c("calls_said.mapper")), "grounded_ok": c("w.grounded"),
        "hard_failed": (c("survivors") == 0) & (c("eliminated") > 0),
    })
    judged = verdict.validity(d, c("winner_iso"), as_of, c("endless"))
    fused = verdict.confidence(judged)
    sure = F.when((verdict.basis(c("class")) == "NO_EXPIRY") & (c("verdict") == "NOT_APPLICABLE"), F.greatest(fused, F.lit(ENDLESS))).otherwise(fused)
    routed = verdict.route(judged.withColumns({"confidence": sure, "confidence_codes": verdict.confidence_codes(judged)}))
    avoided = F.when(c("why") == "NO_DOMAIN_SIGNAL", respond.CALLS_USD).otherwise(c("admission.spend_avoided_usd"))
    return routed.select(
        "doc_id", "class", "class_confidence", F.coalesce("kind.issuer", "own.issuer").alias("issuer"), "kind.side", "basis", "date", F.when(c("date").isNotNull(), c("w.raw")).alias("date_raw"), "verdict", "days_remaining", "decision", "confidence",
        c("final_codes").alias("codes"), c("tier").alias("source_tier"), c("w.label").alias("label"), c("w.snippet").alias("snippet"), "checksum", c("own.detail").alias("checksum_detail"), c("cross.agreement").alias("cross_source"), "anomalies",
        F.coalesce(F.transform("dates_found", lambda x: F.struct(x["raw"], x["iso"], x["role"], x["eliminated_by"])), F.array().cast("array<struct<raw:string,iso:date,role:string,eliminated_by:string>>")).alias("dates_found"),
        c("admission.decision").alias("admission"), avoided.alias("spend_avoided_usd"), F.round(F.aggregate("results", F.lit(0.0), lambda a, r: a + r["usd"]), 6).alias("cost_usd"),
    )


def turned_away(found: DataFrame) -> DataFrame:
    """Responses of documents that no reader saw."""
    c = F.col
    d = found.where("not admitted").withColumn("r", respond.rejected(c("rejected"), c("admission.codes")))
    null = lambda kind: _null(kind)
    return d.select(
        "doc_id", F.lit("NOT_A_DOCUMENT").alias("class"), F.lit(0.0).alias("class_confidence"), null("string").alias("issuer"), F.lit("N/A").alias("side"), F.lit("UNDETERMINED").alias("basis"), null("date").alias("date"), null("string").alias("date_raw"), "r.verdict", null("int").alias("days_remaining"), "r.decision", "r.confidence",
        "r.codes", F.lit("NONE").alias("source_tier"), null("string").alias("label"), null("string").alias("snippet"), null("boolean").alias("checksum"), null("string").alias("checksum_detail"), null("string").alias("cross_source"), _strings().alias("anomalies"),
        F.array().cast("array<struct<raw:string,iso:date,role:string,eliminated_by:string>>").alias("dates_found"), c("admission.decision").alias("admission"), c("admission.spend_avoided_usd").alias("spend_avoided_usd"), F.lit(0.0).alias("cost_usd"),
    )


def run(documents: DataFrame, calls: DataFrame, as_of: Column) -> tuple[DataFrame, dict[str, int]]:
    """Responses, one a document, and how many documents came to each reader, were asked, and stayed open."""
    c = F.col
    figures = {"documents": F.count(F.lit(1)), "admitted": F.count_if("admitted"), "TA_PDF417": F.count_if(c("TA_PDF417").isNotNull()), "TB_OCR": F.count_if("read"), "TA_MRZ": F.count_if(c("TA_MRZ").isNotNull())}
    local, counts = written(read_locally(documents, as_of), "read", **figures)
    kinds, opened = written(classed(local.where("admitted"), as_of), "classed", open=F.count_if("open"))
    called, asked = written(ask(kinds.where("open"), calls, as_of), "asked", TC_VLM=F.count_if(c("TC_VLM").isNotNull()))
    whole = kinds.join(called, "doc_id", "left")
    return decide(whole, as_of).unionByName(turned_away(local)), {k: int(v) for k, v in (counts | opened | asked).items()}
