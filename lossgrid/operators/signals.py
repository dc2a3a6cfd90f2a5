"""Review indicators: twelve weighted signals, score, band and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, incident_key, name_key, token_set

#: Fixed values.
MAJOR, MINOR = 3, 1
BIND_DAYS = 45
LATE_DAYS = 7
LOW_MOST, MEDIUM_MOST = 2, 5
NOT_FINANCED = ("NONE", "NIL", "NA", "N/A", "")
NOT_JUDGED = " [LLM check could not be completed for this claim — treat as NOT evaluated, not as confirmed clean. See server logs.]"
VERDICT = """narrative_coherence STRUCT<triggered: STRING, confidence: STRING, reason: STRING>,
key_status_concern STRUCT<applicable: STRING, triggered: STRING, confidence: STRING, reason: STRING>,
damage_severity_plausibility STRUCT<triggered: STRING, confidence: STRING, reason: STRING>"""


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _signal(code: str, label: str, weight: int, triggered: Column, reason: Column, complete: Column | bool = True) -> tuple[str, int, Column, Column, Column]:
    """Code, weight, whether it is triggered, whether its data are complete, and all that is shown of a signal."""
    hit = F.coalesce(triggered, F.lit(False))
    complete = complete if isinstance(complete, Column) else F.lit(complete)
    return code, weight, hit, complete, F.struct(
        F.lit(code).alias("code"), F.lit(label).alias("label"), F.when(hit, weight).otherwise(0).alias("weight"), F.lit(weight).alias("max_weight"),
        hit.alias("triggered"), reason.alias("reason"), complete.alias("data_complete"),
    )


def _has(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def parse_verdict(text: Column) -> Column:
    """A model's JSON verdict, or null if any of its three objects is not whole: booleans (true, false or their text), a
    known confidence, a reason. Other keys are ignored."""

    def good(v: Column, name: str, flags: tuple[str, ...]) -> Column:
        o = v[name]
        ok = o["confidence"].isin("HIGH", "MODERATE", "LOW") & (F.length(o["reason"]) >= 1)
        for f in flags:
            ok = ok & F.lower(o[f]).isin("true", "false")
        return F.coalesce(ok, F.lit(False))

    whole = lambda v: good(v, "narrative_coherence", ("triggered",)) & good(v, "key_status_concern", ("applicable", "triggered")) & good(v, "damage_severity_plausibility", ("triggered",))
    # bound, as each object that is named would be cut to its own parse
    return bound(F.from_json(text, VERDICT), lambda v: F.when(whole(v), v))


def twelve() -> Column:
    """The signals in order, as an array of structs."""
    return F.array(*[shown for *_, shown in _signals()])


def _signals() -> list[tuple[str, int, Column, Column, Column]]:
    """The signals in order, of _signal. Reads the columns of the waiting-period and history operators, hypothecation_rc, hypothecated,
    authorised_classes, vehicle_class_rc, owner_differs (null: not known; names never come near), failed_checks (array) and
    verdict (of parse_verdict, null if the call failed)."""
    c = F.col
    days, pre = c("days_since_inception"), c("incident_pre_inception")
    rc = c("hypothecation_rc")
    financed = ~F.upper(F.trim(rc)).isin(*NOT_FINANCED)
    both = _has(c("authorised_classes")) & _has(c("vehicle_class_rc"))
    apart = ~F.arrays_overlap(token_set(c("authorised_classes")), token_set(c("vehicle_class_rc")))
    late = F.datediff("received_date", "incident_date")
    failed = F.coalesce(c("failed_checks"), F.array().cast("array<string>"))
    v, theft = c("verdict"), incident_key(c("incident_type")) == "THEFT_COMPLETE"
    judged = v.isNotNull()
    true = lambda name: F.coalesce(F.lower(v[name]["triggered"]) == "true", F.lit(False))
    said = lambda name, none: F.concat(F.coalesce(F.nullif(v[name]["reason"], F.lit("")), F.lit(none)), F.when(judged, "").otherwise(NOT_JUDGED))
    flag = lambda b: F.when(b, "True").otherwise("False")
    bind = F.coalesce(pre, F.lit(False)) | ((days >= 0) & (days <= BIND_DAYS))
    b2b, rep = F.coalesce(c("back_to_back_flag"), F.lit(False)), F.coalesce(c("repeat_claimant_flag"), F.lit(False))
    return [
        _signal("BACK_TO_BACK_CLAIMS", "Back-to-Back Claims", MAJOR, b2b, F.when(b2b, _say("Prior claim on this vehicle was filed ", c("days_since_last_claim").cast("string"), " days before this incident (threshold: 30 or fewer days). Reused from claims history — not re-evaluated here.")).otherwise("No prior claim within 30 days of this incident on this vehicle.")),
        _signal("REPEAT_CLAIMANT", "Repeat Claimant", MINOR, rep, F.when(rep, _say(c("prior_claims_12m_count").cast("string"), " claims filed across all policies for this member in the preceding 12 months (threshold: 3 or more). Reused from claims history — not re-evaluated here.")).otherwise("Fewer than 3 claims for this member in the preceding 12 months.")),
        _signal("BIND_AND_GRIND", "Claim Shortly After Policy Inception", MAJOR, bind, F.when(days.isNull(), "Could not determine days since inception (date parse failure).").when(pre, "Incident date is before policy inception.").when(bind, _say("Incident occurred ", days.cast("string"), f" days after policy inception (threshold: {BIND_DAYS} days or fewer).")).otherwise(_say("Incident occurred ", days.cast("string"), f" days after policy inception — outside the {BIND_DAYS}-day window.")), days.isNotNull()),
        _signal("NCB_DISCREPANCY", "No-Claim Bonus Discrepancy", MINOR, c("ncb_discrepancy").isNotNull(), F.coalesce("ncb_discrepancy", F.lit("No NCB discrepancy against claims history."))),
        _signal("HYPOTHECATION_INCONSISTENCY", "Hypothecation Data Mismatch", MINOR, _has(rc) & (financed != F.coalesce("hypothecated", F.lit(False))), F.when(~_has(rc), "RC hypothecation field not available for comparison.").when(financed != F.coalesce("hypothecated", F.lit(False)), _say("RC hypothecation field ('", rc, "') does not match policy register hypothecated flag (", flag(c("hypothecated")), ").")).otherwise("RC hypothecation field is consistent with the policy register."), _has(rc)),
        _signal("DL_CLASS_MISMATCH", "Driving Licence Class Mismatch", MAJOR, both & apart, F.when(~both, "DL authorised classes or RC vehicle class not available for comparison.").when(apart, _say("DL authorised classes ('", c("authorised_classes"), "') do not appear to cover the insured vehicle's class ('", c("vehicle_class_rc"), "').")).otherwise(_say("DL authorised classes ('", c("authorised_classes"), "') cover the insured vehicle's class ('", c("vehicle_class_rc"), "').")), both),
        _signal("OWNER_NAME_MISMATCH", "Registered Owner Mismatch", MAJOR, c("owner_differs"), F.when(c("owner_differs").isNull(), "Not evaluated — RC owner name and/or FNOL claimant name is not available for comparison.").when(c("owner_differs"), "RC registered owner name does not match the claimant name on file. Names themselves are withheld from this report — verify directly in the source documents.").otherwise("RC registered owner name matches the claimant name on file."), c("owner_differs").isNotNull()),
        _signal("LATE_REPORTING", "Late Reporting", MINOR, late > LATE_DAYS, F.when(late.isNull(), "Could not parse incident date or FNOL received date.").when(late > LATE_DAYS, _say("FNOL received ", late.cast("string"), f" days after the incident date (threshold: {LATE_DAYS} days).")).otherwise(_say("FNOL received ", late.cast("string"), " day(s) after the incident date — within the normal reporting window.")), late.isNotNull()),
        _signal("CROSS_DOC_FIELD_MISMATCH", "Cross-Document Field Mismatch", MINOR, F.size(failed) > 0, F.when(F.size(failed) > 0, _say(F.size(failed).cast("string"), " cross-document field mismatch(es) found: ", F.array_join(failed, ", "), ".")).otherwise("No cross-document field mismatches found.")),
        _signal("NARRATIVE_COHERENCE", "Narrative Coherence", MAJOR, true("narrative_coherence"), said("narrative_coherence", "No narrative contradiction identified."), judged),
        _signal("KEY_STATUS_CONCERN", "Key Status Concern (Theft Claims Only)", MINOR, theft & true("key_status_concern"), F.when(theft, said("key_status_concern", "No key status concern identified.")).otherwise("Not applicable — incident type is not THEFT_COMPLETE."), ~theft | judged),
        _signal("DAMAGE_SEVERITY_PLAUSIBILITY", "Damage Severity Plausibility", MINOR, true("damage_severity_plausibility"), said("damage_severity_plausibility", "No damage severity inconsistency identified."), judged),
    ]


def owner_differs(owner: Column, claimant: Column) -> Column:
    """All that may leave the vault about the two names. Null if one is blank."""
    return F.when((owner != "") & (claimant != ""), name_key(owner) != name_key(claimant))


def band_of(score: Column) -> Column:
    return F.when(score <= LOW_MOST, "LOW").when(score <= MEDIUM_MOST, "MEDIUM").otherwise("HIGH")


def confidence_of(incomplete: Column) -> Column:
    return F.when(incomplete == 0, "HIGH").when(incomplete <= 3, "MODERATE").otherwise("LOW")


def rows(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each signal of each row of df: keep, code, weight, triggered, data_complete. The tests become columns before the rows are made:
    inside the generator each would be made again wherever it is named."""
    each = list(enumerate(_signals()))
    tests = df.select(*keep, *[x.alias(f"_{n}{i}") for i, (_, _, hit, complete, _) in each for n, x in (("hit", hit), ("full", complete))])
    one = lambda i, code, w: F.struct(F.lit(code).alias("code"), F.when(F.col(f"_hit{i}"), w).otherwise(0).alias("weight"), F.col(f"_hit{i}").alias("triggered"), F.col(f"_full{i}").alias("data_complete"))
    return tests.select(*keep, F.inline(F.array(*[one(i, code, w) for i, (code, w, *_) in each])))


def codes() -> Column:
    """The codes of the triggered signals in order, joined by pipe."""
    return F.concat_ws("|", *[F.when(hit, code) for code, _, hit, _, _ in _signals()])


def evaluate(df: DataFrame) -> DataFrame:
    """df with signals, score, band, confidence and adjuster_summary."""
    each = _signals()
    total = lambda parts: sum(parts, F.lit(0))
    # sums are made of the tests, so a query that shows no reasons makes none
    out = df.withColumns({
        "signals": F.array(*[shown for *_, shown in each]), "score": total(F.when(hit, w).otherwise(0) for _, w, hit, _, _ in each),
        "incomplete": total(F.when(c, 0).otherwise(1) for _, _, _, c, _ in each), "n_triggered": total(F.when(hit, 1).otherwise(0) for _, _, hit, _, _ in each),
    })
    out = out.withColumns({"band": band_of(F.col("score")), "confidence": confidence_of(F.col("incomplete"))})
    todo = F.when(F.col("band") == "HIGH", " Recommend referral to SIU for further review. Adjuster to determine next steps.").when(F.col("band") == "MEDIUM", " Review the indicator list before proceeding. Does not independently escalate.").otherwise(" No action required beyond standard triage.")
    return out.withColumn("adjuster_summary", _say(F.col("n_triggered").cast("string"), " of 12 elevated-review indicators are present — Confidence: ", F.col("confidence"), ".", todo))
