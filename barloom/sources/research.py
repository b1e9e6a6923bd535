"""Disclosure payloads (JSON) and filings (XML) to typed rows with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_double, as_text, first_timestamp

# Time formats in the order they are tried, the tags of the named
# figures, and the fields of each payload kind with their time fields by preference.
FORMATS = ("dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MMM-yyyy HH:mm", "dd-MMM-yyyy", "yyyy-MM-dd")
TAGS = {"revenue": "RevenueFromOperations", "other_income": "OtherIncome", "total_income": "Income", "expenses": "Expenses",
        "profit_before_tax": "ProfitBeforeTax", "tax_expense": "TaxExpense", "profit_after_tax": "ProfitLossForPeriod",
        "eps_basic": "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "eps_diluted": "DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations",
        "face_value": "FaceValueOfEquityShareCapital", "paid_up_capital": "PaidUpValueOfEquityShareCapital", "finance_costs": "FinanceCosts",
        "depreciation": "DepreciationDepletionAndAmortisationExpense", "employee_cost": "EmployeeBenefitExpense"}
PERIOD_START, PERIOD_END = "DateOfStartOfReportingPeriod", "DateOfEndOfReportingPeriod"
KINDS = {
    "result": (("symbol", "audited", "consolidated", "broadCastDate", "exchdisstime", "filingDate", "fromDate", "toDate", "period", "xbrl", "isin"),
               ("broadCastDate", "exchdisstime", "filingDate")),
    "announcement": (("symbol", "desc", "an_dt", "sort_date", "exchdisstime", "attchmntText", "attchmntFile"), ("an_dt", "sort_date", "exchdisstime")),
    "board_meeting": (("symbol", "bm_date", "bm_purpose", "bm_desc", "bm_timestamp", "exchdisstime"), ("bm_timestamp", "exchdisstime")),
    "shareholding": (("symbol", "date", "broadcastDate", "systemDate", "pr_and_prgrp", "public_val", "employeeTrusts"), ("broadcastDate", "systemDate")),
    "insider_deal": (("symbol", "acqName", "acqMode", "afterAcqSharesNo", "afterAcqSharesPer", "acqfromDt", "acqtoDt", "date", "exchdisstime", "intimDt", "anex"),
                     ("date", "exchdisstime", "intimDt")),
    "event": (("symbol", "company", "purpose", "bm_desc", "date"), ("date",)),
}


def parse(payloads: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Rows of a JSON array payload with ``disclosed_at``.

    The first usable time among the preferred fields counts. A row with none has
    ``disclosed_at`` NULL and belongs to ``undated``.
    """
    fields, times = KINDS[kind]
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    r = payloads.select(F.explode(F.from_json(body, schema)).alias("r")).select("r.*")
    return r.withColumn("disclosed_at", first_timestamp(times, FORMATS))


def undated(rows: DataFrame, kind: str) -> DataFrame:
    raw = F.to_json(F.struct(*[c for c in rows.columns if c != "disclosed_at"]))
    return rows.where("disclosed_at IS NULL").select("symbol", F.lit(kind).alias("kind"), F.lit("no disclosure time").alias("reason"), raw.alias("raw"))


def tri_state(c, yes: str, no: str) -> Column:
    """True, false, or NULL when the source did not say."""
    t = F.lower(as_text(c))
    return F.when(t == yes.lower(), True).when(t == no.lower(), False)


def results(rows: DataFrame) -> DataFrame:
    r = rows.where("disclosed_at IS NOT NULL")
    x = as_text("xbrl")
    return r.select("symbol", "disclosed_at", F.to_date(first_timestamp(["fromDate"], FORMATS)).alias("period_start"),
                    F.to_date(first_timestamp(["toDate"], FORMATS)).alias("period_end"), tri_state("audited", "Audited", "Un-Audited").alias("audited"),
                    tri_state("consolidated", "Consolidated", "Non-Consolidated").alias("consolidated"),
                    F.when(~x.endswith("/-"), x).alias("xbrl_url"), as_text("isin").alias("isin"), result_period("period").alias("period"))


def shareholding(rows: DataFrame) -> DataFrame:
    return rows.where("disclosed_at IS NOT NULL").select(
        "symbol", "disclosed_at", F.to_date(first_timestamp(["date"], FORMATS)).alias("as_at"), as_double("pr_and_prgrp").alias("promoter_pct"),
        as_double("public_val").alias("public_pct"), as_double("employeeTrusts").alias("employee_trust_pct"))


def insider_deals(rows: DataFrame) -> DataFrame:
    """Deals by the time they were made known, which comes after ``to_date``, the day the deal was done."""
    return rows.where("disclosed_at IS NOT NULL").select(
        "symbol", "disclosed_at", as_text("acqName").alias("acquirer"), as_text("acqMode").alias("mode"),
        as_double("afterAcqSharesNo").alias("shares_after"), as_double("afterAcqSharesPer").alias("pct_after"),
        F.to_date(first_timestamp(["acqfromDt"], FORMATS)).alias("from_date"), F.to_date(first_timestamp(["acqtoDt"], FORMATS)).alias("to_date"),
        as_text("anex").alias("regulation"))


def announcements(rows: DataFrame) -> DataFrame:
    return rows.where("disclosed_at IS NOT NULL").select(
        "symbol", "disclosed_at", as_text("desc").alias("category"), as_text("attchmntText").alias("text"), as_text("attchmntFile").alias("attachment_url"))


def result_period(c) -> Column:
    """Quarter, half year or year, from the source's wording."""
    t = F.lower(F.coalesce(as_text(c), F.lit("")))
    return (F.when(t.startswith("quarter"), "quarterly").when(t.contains("half"), "half_yearly")
            .when(t.startswith("annual") | t.startswith("year"), "annual").otherwise("unknown"))


def board_meetings(rows: DataFrame) -> DataFrame:
    return rows.where("disclosed_at IS NOT NULL").select(
        "symbol", "disclosed_at", F.to_date(first_timestamp(["bm_date"], FORMATS)).alias("meeting_date"), as_text("bm_purpose").alias("purpose"),
        as_text("bm_desc").alias("description"))


def events(rows: DataFrame) -> DataFrame:
    """Market-wide events; rows without a symbol or a date are dropped."""
    return (rows.where(as_text("symbol").isNotNull() & F.col("disclosed_at").isNotNull())
            .select(as_text("symbol").alias("symbol"), F.to_date("disclosed_at").alias("event_date"), as_text("purpose").alias("purpose"),
                    as_text("bm_desc").alias("description")))


def xbrl_facts(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(document, context, tag, text) of every fact element of an XML filing.

    Facts are elements with a contextRef and text; one expression pulls them out
    of the document text, so the walk stays in the JVM.
    """
    element = r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)\s[^>]*?contextRef=[\"']([^\"']+)[\"'][^>]*>([^<]+)<"
    pull = lambda g: F.regexp_extract_all(xml, F.lit(element), F.lit(g))
    z = F.arrays_zip(pull(1).alias("tag"), pull(2).alias("ctx"), pull(3).alias("text"))
    return (docs.select(key, F.posexplode(z).alias("pos", "f")).select(key, "pos", "f.ctx", "f.tag", F.trim("f.text").alias("text"))
            .where(F.length("text") > 0))


def xbrl_periods(facts: DataFrame, key: str) -> DataFrame:
    """One row per reporting context: dates from its own facts, named figures and
    the full tag-to-number map. A fact that is stated again in its context counts
    with its last text. Contexts without a reporting period are breakdowns and are
    left out; ``skipped_contexts`` counts them."""
    num = F.col("text").try_cast("double")
    last = facts.groupBy(key, "ctx", "tag").agg(F.max("pos").alias("pos"))
    facts = facts.join(last, [key, "ctx", "tag", "pos"], "left_semi")
    g = facts.groupBy(key, "ctx").agg(
        F.max_by("text", F.when(F.col("tag") == PERIOD_START, F.col("pos"))).alias("s"), F.max_by("text", F.when(F.col("tag") == PERIOD_END, F.col("pos"))).alias("e"),
        F.max_by("text", F.when(F.col("tag") == "NatureOfReportStandaloneConsolidated", F.col("pos"))).alias("nature"),
        F.max_by("text", F.when(F.col("tag") == "WhetherResultsAreAuditedOrUnaudited", F.col("pos"))).alias("status"),
        *[F.max_by(num, F.when(F.col("tag") == tag, F.col("pos"))).alias(n) for n, tag in TAGS.items()],
        F.map_from_entries(F.array_compact(F.collect_set(F.when(num.isNotNull(), F.struct("tag", num.alias("v")))))).alias("facts"))
    g = g.withColumns({"period_start": F.try_to_timestamp("s", F.lit("yyyy-MM-dd")).cast("date"), "period_end": F.try_to_timestamp("e", F.lit("yyyy-MM-dd")).cast("date")})
    ok = g.where(F.col("period_end") >= F.col("period_start"))
    return ok.withColumns({"months": months("period_start", "period_end"),
                           "consolidated": tri_state("nature", "Consolidated", "Standalone"),
                           "audited": tri_state("status", "Audited", "Unaudited")}).drop("s", "e", "nature", "status")


def skipped_contexts(facts: DataFrame, key: str) -> DataFrame:
    g = facts.groupBy(key, "ctx").agg(F.count_if(F.col("tag").isin(PERIOD_START, PERIOD_END)).alias("k"))
    return g.groupBy(key).agg(F.count_if(F.col("k") < 2).alias("skipped"))


def months(start, end) -> Column:
    days = F.datediff(end, start) + 1
    return F.greatest(F.lit(1), F.round(days / 30.44)).cast("int")
