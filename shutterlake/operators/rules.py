"""Alert rules and their evaluation against enriched events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions import detections as D
from shutterlake.functions.plans import once
from shutterlake.functions.text import given
from shutterlake.functions.times import as_column
from shutterlake.operators import changes
from shutterlake.schemas import CONDITION_TYPES, OPERATORS, SEVERITIES

DEFAULT_COOLDOWN_S = 300
# Numbers fall into this many steps; rules are joined to the steps they may hold in.
STEPS = 64
# Rules that hold for almost everything are spread over this many keys.
SPREAD = 16

RULE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("cond_type", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("species", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("cooldown_s", T.LongType()),
])


def from_documents(documents: DataFrame) -> DataFrame:
    """Rule rows from documents with a JSON `conditions` text.

    `value` may be a number, a text or a list; `species` a text or a list. Both
    become a threshold and a list of names.
    """
    shape = "type string, operator string, value string, deviceId string, species string"
    c = F.from_json("conditions", shape)
    value, species = c["value"], c["species"]

    def names(text: Column) -> Column:
        return F.coalesce(F.from_json(text, "array<string>"), F.when(given(text).isNotNull(), F.array(text)))

    return documents.select(
        "rule_id", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"),
        c["type"].alias("cond_type"), c["operator"].alias("op"),
        value.try_cast("double").alias("threshold"),
        F.when(c["type"] == "species", F.coalesce(names(species), names(value))).alias("species"),
        given(c["deviceId"]).alias("device_id"), "severity",
        F.coalesce(F.nullif("cooldown_s", F.lit(0)), F.lit(DEFAULT_COOLDOWN_S)).cast("long").alias("cooldown_s"),
    )


def invalid(rules: DataFrame) -> DataFrame:
    """Rules that miss a required field or hold a value outside the allowed ones."""
    problems = {
        "name": given(F.col("name")).isNull(),
        "severity": ~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)),
        "cond_type": ~F.coalesce(F.col("cond_type").isin(CONDITION_TYPES), F.lit(False)),
        "op": ~F.coalesce(F.col("op").isin(OPERATORS), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in problems.items()]))
    return rules.withColumn("problems", found).filter(F.size("problems") > 0)


def current_rules(rule_changes: DataFrame) -> DataFrame:
    """Rules after all create/update/delete rows, defaults filled in."""
    fields = ["name", "enabled", "cond_type", "op", "threshold", "species", "device_id", "severity", "cooldown_s"]
    # What a change does is its `action`; logs without one say so in `op`, and cannot change a rule's operator.
    action = "action" if "action" in rule_changes.columns else "op"
    rows = changes.patched(rule_changes, "rule_id", ["changed_at", "seq"], fields, action)
    return rows.withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)),
        "cooldown_s": F.coalesce(F.nullif("cooldown_s", F.lit(0)), F.lit(DEFAULT_COOLDOWN_S)).cast("long"),
    })


def versions(rule_changes: DataFrame) -> DataFrame:
    """Every state a rule has had, with the times `valid_from` (inclusive) and `valid_to` (exclusive, null: still) it held.

    A rule holds from its creation on; each update patches the fields it gives, a deletion ends it, and a rule created
    again begins with what it had. Changes of one time count as one, in order of seq.
    """
    order = Window.partitionBy("rule_id").orderBy("changed_at", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fields = ["name", "enabled", "cond_type", "op", "threshold", "species", "device_id", "severity", "cooldown_s"]
    states = rule_changes.withColumns({
        **{f: F.last(f, ignorenulls=True).over(upto) for f in fields},
        "_made": F.max(F.col("action") == "create").over(upto), "_next": F.lead("changed_at").over(order),
    })
    held = F.col("_made") & (F.col("action") != "delete") & (F.col("_next").isNull() | (F.col("_next") > F.col("changed_at")))
    return states.filter(held).select(
        "rule_id", *[c for c in fields if c not in ("enabled", "cooldown_s")], F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce(F.nullif("cooldown_s", F.lit(0)), F.lit(DEFAULT_COOLDOWN_S)).cast("long").alias("cooldown_s"),
        F.col("changed_at").alias("valid_from"), F.col("_next").alias("valid_to"))


def candidates_as_of(enriched: DataFrame, rule_versions: DataFrame) -> DataFrame:
    """`candidates` by the version of each rule that held at the event's time."""
    number = F.concat_ws("|", "rule_id", F.unix_micros("valid_from").cast("string"))
    named = rule_versions.withColumn("_version", number)
    found = candidates(enriched, named.withColumn("rule_id", F.col("_version")))
    held = named.select(F.col("_version").alias("rule_id"), F.col("rule_id").alias("_rule"), "valid_from", "valid_to")
    at = F.col("triggered_at")
    return (
        found.join(held, "rule_id").filter((at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
        .withColumn("rule_id", F.col("_rule")).drop("_rule", "valid_from", "valid_to")
    )


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """value op threshold; an unknown operator is false."""
    return (
        F.when(op == ">", value > threshold).when(op == "<", value < threshold)
        .when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)
        .when(op == "==", value == threshold).when(op == "!=", value != threshold)
        .otherwise(F.lit(False))
    )


def holds(rule: Column, count: Column, top_confidence: Column, classes: Column) -> Column:
    """Whether a rule's condition is true for an event; null-safe."""
    any_hit = F.arrays_overlap(F.transform(rule["species"], lambda s: F.lower(s)), classes)
    by_species = F.when(rule["op"].isin("in", "=="), any_hit).when(rule["op"].isin("not_in", "!="), ~any_hit)
    some = F.size(classes) > 0
    verdict = (
        F.when(rule["cond_type"] == "detection_count", compare(count.cast("double"), rule["op"], rule["threshold"]))
        .when((rule["cond_type"] == "confidence") & some, compare(top_confidence, rule["op"], rule["threshold"]))
        .when((rule["cond_type"] == "species") & some, by_species)
    )
    return F.coalesce(verdict, F.lit(False))


def _rule_columns() -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in RULE]


def _facts(enriched: DataFrame) -> DataFrame:
    known = enriched.filter(given(F.col("device_id")).isNotNull()).select(
        "device_id", F.col("timestamp").alias("triggered_at"), "shot_id", "image_url",
        F.coalesce("detection_count", F.lit(0)).alias("detection_count"), "detections",
    )
    d = F.col("_d")
    return once(
        once(known, _d=D.parse(F.col("detections"))),
        detections_count=F.size(d), top_confidence=D.max_confidence(d),
        _classes=D.classes_lower(d), class_list=D.class_list(d),
    ).drop("_d", "detections")


def _slot(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def _step(value: Column, per_unit: int) -> Column:
    """The step a number falls into; the first and last reach to infinity."""
    step = F.floor(value * per_unit)
    return F.when(F.isnan(value.cast("double")), F.lit(STEPS)).otherwise(F.greatest(F.lit(0), F.least(F.lit(STEPS), step)))


def _steps_of(kind: str, per_unit: int) -> Column:
    """Slots of the steps in which a rule over a number may hold."""
    op, limit = F.col("op"), F.col("threshold")

    def may_hold(s: Column) -> Column:
        low = F.when(s == 0, F.lit(float("-inf"))).otherwise(s / per_unit)
        high = F.when(s == STEPS, F.lit(float("inf"))).otherwise((s + 1) / per_unit)
        return (
            F.when(op.isin(">", ">="), high >= limit).when(op.isin("<", "<="), low <= limit)
            .when(op == "==", (low <= limit) & (limit <= high)).otherwise(op == "!=")
        )

    steps = F.filter(F.sequence(F.lit(0), F.lit(STEPS)), may_hold)
    return F.transform(steps, lambda s: _slot(kind, s))


def _spread_slots() -> Column:
    return F.array(*[F.lit(f"spread:{k}") for k in range(SPREAD)])


def _spread_slot(*columns: str) -> Column:
    return _slot("spread", F.pmod(F.xxhash64(*columns), F.lit(SPREAD)))


def lay_beside(
    facts: DataFrame, rules: DataFrame, probes: Column, slots: Column, fires: Callable[[Column], Column],
) -> DataFrame:
    """`facts` rows with the columns of each enabled rule that fires for them.

    One equi join, however many rules there are: a rule stands under each of
    its `slots`, a row is looked up under its `probes`, both per device and for
    rules of all devices. A pair that may fire meets in one slot or more;
    `fires` decides exactly and must hold in one of them only, for which it may use `_slot`.
    Rules of all devices stand under `SPREAD` salts, of which each row draws one, so rows that
    share a slot do not share a key.
    """
    every = F.array(*[F.lit(k) for k in range(SPREAD)])
    placed = rules.filter(F.col("enabled")).withColumns({
        "_device": F.coalesce(given(F.col("device_id")), F.lit("")), "_slots": F.array_distinct(slots),
    })
    salts = F.when(F.col("_device") == "", every).otherwise(F.array(F.lit(0)))
    entries = placed.select(*_rule_columns(), "_device", F.explode("_slots").alias("_slot"), salts.alias("_salts")).select(
        *RULE.names, "_device", "_slot", F.explode("_salts").alias("_salt"))
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(SPREAD)).cast("int")
    place = lambda device, salt: F.struct(device.alias("device"), salt.alias("salt"))
    fleet, own = place(F.lit(""), salt), F.coalesce("device_id", F.lit(""))
    places = F.when(own == "", F.array(fleet)).otherwise(F.array(place(own, F.lit(0)), fleet))
    looked_up = facts.withColumns({"_slots": F.array_distinct(probes), "_places": places})
    keyed = looked_up.select(*facts.columns, "_places", F.explode("_slots").alias("_slot")).select(
        *facts.columns, "_slot", F.explode("_places").alias("_place")).select(
        *facts.columns, "_slot", F.col("_place.device").alias("_device"), F.col("_place.salt").alias("_salt"))
    rule = F.struct(*RULE.names)
    return keyed.join(entries, ["_device", "_slot", "_salt"]).filter(fires(rule)).select(*RULE.names, *facts.columns)


def pairs(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row with each enabled rule that watches its device, whatever the rule's condition."""
    return lay_beside(facts, rules, F.array(_spread_slot(*facts.columns)), _spread_slots(), lambda rule: F.lit(True))


def candidates(enriched: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (event, rule) pair whose condition holds, before any cooldown."""
    some = F.size("_classes") > 0
    none = F.array().cast("array<string>")
    probes = F.concat(
        F.array(_slot("detection_count", _step(F.col("detection_count"), 1))),
        F.when(some, F.concat(
            F.array(_slot("confidence", _step(F.coalesce("top_confidence", F.lit(0.0)), STEPS)), _spread_slot("device_id", "triggered_at")),
            F.transform("_classes", lambda c: _slot("class", c)),
        )).otherwise(none),
    )
    kind, op = F.col("cond_type"), F.col("op")
    slots = (
        F.when(kind == "detection_count", _steps_of("detection_count", 1))
        .when(kind == "confidence", _steps_of("confidence", STEPS))
        .when((kind == "species") & op.isin("in", "=="), F.transform("species", lambda s: _slot("class", F.lower(s))))
        .when((kind == "species") & op.isin("not_in", "!="), _spread_slots())
    )

    def fires(rule: Column) -> Column:
        # A rule of several species meets a row once per species that both have; the first of them counts.
        shared = F.array_min(F.array_intersect(F.transform(rule["species"], lambda s: F.lower(s)), F.col("_classes")))
        once_only = ~F.startswith("_slot", F.lit("class:")) | (F.col("_slot") == _slot("class", shared))
        return once_only & holds(rule, F.col("detection_count"), F.col("top_confidence"), F.col("_classes"))

    return lay_beside(_facts(enriched), rules, probes, slots, fires).drop("_classes")


def silence_candidates(gaps: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """device_offline rules: one candidate per silence longer than the threshold.

    `gaps` has device_id, ts and next_ts (null after the last message). A
    candidate's time is the moment its threshold is passed.
    """
    end = F.unix_micros(F.coalesce("next_ts", as_column(as_of)))
    spans = gaps.select("device_id", "ts", ((end - F.unix_micros("ts")) / 1e6).alias("silent_s"))
    watching = rules.filter(F.col("cond_type") == "device_offline")
    # Silences fall into powers of two seconds; a rule stands in all from its threshold on.
    power = lambda x: F.least(F.lit(STEPS), F.floor(F.log2(F.greatest(x, F.lit(0.0)) + 1)))
    slots = F.transform(
        F.sequence(power(F.col("threshold").cast("double")), F.lit(STEPS).cast("long")), lambda s: _slot("silent", s))
    hits = lay_beside(
        spans, watching, F.array(_slot("silent", power(F.col("silent_s")))), slots, lambda rule: F.col("silent_s") > rule["threshold"])
    passed = F.unix_micros("ts") + (F.col("threshold") * 1e6).cast("long")
    return hits.withColumn("triggered_at", F.timestamp_micros(passed)).drop("ts")


def number_text(x: Column) -> Column:
    """A number without a trailing `.0`."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def message() -> Column:
    """Alert text over the columns of `candidates`."""
    limit = F.concat(F.lit("threshold: "), F.col("op"), F.lit(" "), number_text(F.col("threshold")), F.lit(")"))
    percent = F.format_string("%.1f", F.col("top_confidence") * 100)
    return (
        F.when(
            F.col("cond_type") == "detection_count",
            F.concat(F.lit("Alert: "), F.col("detection_count").cast("string"), F.lit(" objects detected ("), limit),
        )
        .when(
            F.col("cond_type") == "confidence",
            F.concat(F.lit("Alert: High confidence detection ("), percent, F.lit("%, "), limit),
        )
        .when(F.col("cond_type") == "species", F.concat(F.lit("Alert: Species detected: "), F.col("class_list")))
        .otherwise(F.concat(F.lit("Alert triggered: "), F.col("name")))
    )


def alert_id(rule_id: Column, device_id: Column, at: Column) -> Column:
    """The same firing always gets the same id."""
    return F.sha2(F.concat_ws("|", rule_id, device_id, F.unix_micros(at).cast("string")), 256)


def as_alerts(fired: DataFrame, now=None) -> DataFrame:
    """Fired candidates as rows of the alerts table."""
    conditions = F.struct(
        F.col("cond_type").alias("type"), F.col("op").alias("operator"),
        F.col("threshold").alias("value"), "species",
    )
    metadata = F.to_json(F.struct("detection_count", "detections_count", conditions.alias("conditions")))
    none = F.lit(None)
    return fired.select(
        alert_id(F.col("rule_id"), F.col("device_id"), F.col("triggered_at")).alias("alert_id"),
        "rule_id", F.col("name").alias("rule_name"), "device_id", "severity", message().alias("message"),
        "triggered_at", none.cast("timestamp").alias("acknowledged_at"), F.lit("").alias("acknowledged_by"),
        none.cast("timestamp").alias("resolved_at"), F.lit("").alias("resolved_by"),
        F.lit("active").alias("status"), metadata.alias("metadata"),
        (as_column(now) if now is not None else F.col("triggered_at")).alias("created_at"),
        F.to_date("triggered_at").alias("processing_date"),
    )
