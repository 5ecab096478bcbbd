"""The engine's entry points over tables of strings: analyse, check before a run, preview, protect, report."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import values as V
from tabveil.functions.blake3 import token_udf
from tabveil.operators import audit, distribution, profile, smart, spans, strategies, uniqueness
from tabveil.plans import review as told
from tabveil.sources import csvfile

PREVIEW_MOST = 100
#: What a pseudonym still tells, by type; types not here keep nothing of their subject.
DISCLOSURES = {
    "email": "the domain behind the @ stays", "timestamp": "the time of day stays, and the date moves by a year at most", "phone": "number and grouping of the digits stay", "numericId": "the number of digits and leading zeros stay",
    "numericValue": "sign, digits and decimals keep their number", "firstName": "the number of name parts stays", "lastName": "the number of name parts stays", "fullName": "the number of name parts stays",
    **dict.fromkeys(("address", "postalCode", "ipAddress", "url", "macAddress", "taxId", "string", "unknown"), "the length stays within a fifth"),
}
DIRECT = {"email", "phone", "firstName", "lastName", "fullName", "address", "taxId"}
QUASI = {"uuid", "numericId", "postalCode", "ipAddress", "macAddress", "url", "timestamp", "countryCode"}


@dataclass
class ColumnPlan:
    """What a column is and what is to be done with it."""

    name: str
    index: int
    kind: str
    risk: str
    strategy: str
    selected: bool
    placeholder: str = ""
    ambiguous: bool = False
    evidence: list[tuple[str, str, int]] = field(default_factory=list)
    sample: list[str] = field(default_factory=list)

    @property
    def changes(self) -> bool:
        passes = self.strategy in ("auto", "pseudonymize") and self.kind in uniqueness.PASS_THROUGH
        return self.selected and self.strategy != "passThrough" and not passes


def disposition(p: profile.Profile) -> str:
    if profile.RANK[p.risk] > 0 and p.non_empty:
        return "detectedSensitive"
    if not p.non_empty:
        return "analysisIncomplete"
    return "testedBenign" if p.kind not in ("string", "unknown") and p.confidence != "low" and sum(c.isalnum() for c in p.header) >= 3 else "uncertain"


def planned(df: DataFrame, names: list[str] | None = None, order: str | None = None) -> list[ColumnPlan]:
    """A plan for each column from all rows; headers that read alike are ambiguous. order: a column of df that is no column of the table; by it a plan keeps its first five values."""
    shown: dict[str, list[str]] = {}
    if order:
        for r in sorted(profile.first_values(df, order, [c for c in df.columns if c != order]).collect(), key=lambda r: r["place"]):
            shown.setdefault(r["col"], []).append(r["value"])
        df = df.drop(order)
    names = names or df.columns
    cells = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    labels = [strategies.column_label(n, i) for i, n in enumerate(names)]
    out = []
    for p, name, label, c in zip(profile.profiled(cells, names), names, labels, df.columns, strict=True):
        best = max((e for e in p.evidence), key=lambda e: _priority(e[0]), default=None)
        mark = strategies.placeholder(name, p.index, p.kind, best and best[0], p.kind, labels.count(label) > 1)
        out.append(ColumnPlan(name, p.index, p.kind, p.risk, p.strategy, p.selected, mark, labels.count(label) > 1, p.evidence, shown.get(c, [])))
    return out


def _found_in(sample: list[str]) -> list[tuple[str, str, int]]:
    """Evidence in the values that a plan keeps: (kind, detector, rows)."""
    rows: dict[tuple[str, str], set[int]] = {}
    for at, text in enumerate(sample):
        for s in spans.find(text):
            rows.setdefault((s[3], s[7]), set()).add(at)
    return [(kind, detector, len(at)) for (kind, detector), at in sorted(rows.items())]


def _priority(kind: str) -> int:
    return spans.KIND_PRIORITY.get(kind, 0)


def controlled(plans: list[ColumnPlan], selected: list[int], controls: dict[int, dict] | None = None) -> list[ColumnPlan]:
    """Plans with the user's selection, types and strategies; a type never lowers the risk that was found, and the kept values are looked at again under it."""
    if bad := [i for i in [*selected, *(controls or {})] if not 0 <= i < len(plans)]:
        raise IndexError(f"no column {bad[0]}; there are {len(plans)}")
    out = []
    for p in plans:
        c = (controls or {}).get(p.index, {})
        kind, strategy = c.get("type", p.kind), c.get("strategy", p.strategy)
        if strategy not in strategies.STRATEGIES:
            raise ValueError(f"no strategy {strategy}")
        risk = max(p.risk, profile.RISK.get(kind, "low"), key=profile.RANK.get)
        evidence = p.evidence
        if "type" in c:
            new = _found_in(p.sample)
            risk = max([risk, *("medium" if k in spans.MEDIUM else "high" for k, _, _ in new)], key=profile.RANK.get)
            evidence = evidence + [e for e in new if e[:2] not in {x[:2] for x in evidence}]
        mark = p.placeholder if kind == p.kind else strategies.placeholder(p.name, p.index, kind, ambiguous=p.ambiguous)
        out.append(replace(p, kind=kind, strategy=strategy, risk=risk, selected=p.index in selected, placeholder=mark, evidence=evidence))
    return out


def defaults_after_spans(plans: list[ColumnPlan], found: dict[str, list[tuple[str, str, int]]]) -> list[ColumnPlan]:
    """Plans of a pasted document's fields with the spans found in them: a risk that rises brings its default strategy and selects the field."""
    out = []
    for p in plans:
        new = found.get(p.name, [])
        risk = max([p.risk, *("medium" if k in spans.MEDIUM else "high" for k, _, _ in new)], key=profile.RANK.get)
        rose = profile.RANK[risk] > profile.RANK[p.risk]
        out.append(replace(p, risk=risk, evidence=p.evidence + new, strategy="redact" if rose else p.strategy, selected=p.selected or rose))
    return out


def protected(df: DataFrame, plans: list[ColumnPlan], seed: Column, order: str, provider: smart.ReplacementProvider | None = None, known: DataFrame | None = None, token_key: str | None = None) -> DataFrame:
    """df with selected columns rewritten. token_key: 64 hexadecimal digits, for tokens that repeat over releases. One projection for all that needs no map, then a join for each that does."""
    columns = [c for c in df.columns if c != order]
    direct, mapped = {}, []
    for p, c in zip(plans, columns, strict=True):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        e = strategies.expression(v, p.kind, "pseudonymize" if p.strategy == "localAi" else p.strategy, p.name, p.index, seed, p.placeholder or None) if p.selected else v
        if p.selected and p.strategy == "tokenize" and token_key:
            e = strategies.blank_kept(v, token_udf(token_key, p.name, p.index)(V.trimmed(v)))
        direct[c] = v if e is None else e
        if p.selected and (e is None or (p.strategy == "localAi" and provider)):
            mapped.append((p, c))
    # Columns that need a map keep their source beside them; each map is joined by its key, small ones without an exchange.
    sources = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for _, c in mapped}
    out = df.select(order, *[e.alias(c) for c, e in direct.items()], *[e.alias(f"_s_{c}") for c, e in sources.items()])
    for p, c in mapped:
        own, v = df.select(order, sources[c].alias("_v")), F.col(f"`_s_{c}`")
        if p.strategy == "label":
            label = p.placeholder.strip("[]") if p.ambiguous else strategies.column_label(p.name, p.index)
            out = strategies.labels(out.drop(c), f"_s_{c}", order, label, c)
            continue
        if p.strategy == "localAi" and provider:
            answers = smart.generated(smart.wanted(own.select(F.lit(c).alias("col"), F.col("_v").alias("value")), known), provider).where("reason is null")
            table = answers.select(V.identity_key(F.col("value")).alias("_k"), F.col("output").alias("_o"))
        elif p.kind == "email":
            table = strategies.email_mapping(own.select(F.col("_v").alias("value")), seed).select(F.col("key").alias("_k"), F.col("output").alias("_o"))
        else:
            table = _names(own, p.kind, seed)
        rest = strategies.blank_kept(v, F.coalesce("_o", strategies.generic(V.trimmed(v), seed)))
        out = out.withColumn("_k", V.identity_key(v)).join(table, "_k", "left").withColumn(c, rest).drop("_k", "_o")
    return out.select(order, *columns)


def _names(source: DataFrame, kind: str, seed: Column) -> DataFrame:
    """(_k, _o): names put together from the outputs of their tokens; last tokens of full names are last names."""
    keys = source.select(V.identity_key(F.col("_v")).alias("_k")).where("_k <> ''").distinct()
    values = keys.select(F.col("_k").alias("value"))
    parts = keys.select("_k", F.posexplode(F.split("_k", " ")).alias("at", "key"), (F.size(F.split("_k", " ")) - 1).alias("end"))
    first, last = strategies.name_mapping(values, seed, "firstName").withColumnRenamed("output", "_f"), strategies.name_mapping(values, seed, "lastName").withColumnRenamed("output", "_l")
    is_last = F.lit(kind == "lastName") | ((F.lit(kind) == "fullName") & (F.col("at") == F.col("end")) & (F.col("end") > 0))
    named = parts.join(first, "key").join(last, "key").withColumn("o", F.when(is_last, F.col("_l")).otherwise(F.col("_f")))
    return named.groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "o"))), lambda s: s["o"]), " ").alias("_o"))


def measured(source: DataFrame, released: DataFrame, plans: list[ColumnPlan], order: str) -> dict:
    """Figures of a run: row uniqueness, effect of each column, unchanged and residual values, distributions.

    The release is kept on the executors' disks meanwhile, as each figure reads it; what is lost is computed again.
    """
    released = released.persist(StorageLevel.DISK_ONLY)
    try:
        return _figures(source, released, plans, order)
    finally:
        released.unpersist()


def _figures(source: DataFrame, released: DataFrame, plans: list[ColumnPlan], order: str) -> dict:
    columns = [c for c in released.columns if c != order]
    parts = {c: uniqueness.projection(F.col(f"`{c}`"), p.kind, p.strategy, p.selected)[1] for p, c in zip(plans, columns, strict=True)}
    rows = uniqueness.projected(released, parts)
    whole = uniqueness.summary(released.select(*[F.col(f"`{c}`") for c in columns])).first().asDict()
    matched = [r["col"] for r in uniqueness.matched_columns(rows).where("matched").collect()]
    summary = uniqueness.summary(rows.select(*matched)).first().asDict() if matched else {"rows_measured": released.count(), "distinct_classes": 0, "unique_rows": 0, "smallest_class": 0, "fifth_percentile_class_size": 0}
    effects = sorted(((r["unique_rows_without"], r["col"]) for r in uniqueness.leave_one_out(rows.select(*matched)).collect())) if len(matched) > 1 and summary["unique_rows"] else []
    sensitive = [c for p, c in zip(plans, columns, strict=True) if p.changes and profile.RANK[p.risk] > 0]
    pairs = source.select(order, *[F.col(f"`{c}`").cast("string").alias(f"s_{c}") for c in columns]).join(released, order)
    same = {r["col"]: r["unchanged"] for r in audit.unchanged(pairs, {c: (f"s_{c}", c) for c in sensitive}).collect()} if sensitive else {}
    residual = audit.residual(pairs, [f"s_{c}" for c in sensitive], columns).first().asDict() if sensitive else {"protected_values": 0, "released_values": 0, "overlap": 0}
    mapping = [c for p, c in zip(plans, columns, strict=True) if p.changes and distribution.ENTRIES[p.strategy]]
    stats = [r.asDict() for r in distribution.with_risk(distribution.distribution(source, mapping)).collect()] if mapping else []
    return {"uniqueness": summary, "matched": matched, "effects": effects, "unchanged": same, "residual": residual, "distributions": stats, "classes": whole}


def report(plans: list[ColumnPlan], figures: dict | None = None, coverage: tuple[int, int] | None = None, blockers: list[str] | None = None, replacements: told.Replacements | None = None, keyed: dict[str, int] | None = None, detection: dict | None = None) -> dict:
    """Readiness, evidence, columns, metrics and notes. replacements: a plug-in's counts; keyed: column -> distinct values with keyed tokens; detection: see `review.detection_summary`. After a run the status is never better than review: nothing here certifies anonymity."""
    chosen = [p for p in plans if p.selected]
    left = [p.name for p in plans if not p.selected and profile.RANK[p.risk] > 0]
    evidence = [
        {"id": "coverage", "status": "verified" if len(chosen) == len(plans) else "review", "detail": f"{len(chosen)} of {len(plans)} columns are selected."},
        {"id": "detector-risk", "status": "review" if left else "verified", "detail": f"Columns of risk outside the selection: {', '.join(left) or 'none'}."},
    ]
    review = [e["detail"] for e in evidence[1:] if e["status"] == "review"]
    verified = ["Equal source values have equal outputs within the run."] + [e["detail"] for e in evidence[1:] if e["status"] == "verified"]
    notes = [f"{p.name}: a pseudonym of type {p.kind}: {DISCLOSURES[p.kind]}." for p in chosen if p.strategy in ("auto", "pseudonymize", "localAi") and p.kind in DISCLOSURES]
    if figures:
        u, total = figures["uniqueness"], figures["uniqueness"]["rows_measured"]
        status = uniqueness.verdict(u, len(figures["matched"]))
        share = told.unique_share(u["unique_rows"], total)
        evidence.append({"id": "row-uniqueness", "status": status, "detail": f"{u['unique_rows']} of {total} rows ({share}) are unique on {', '.join(figures['matched']) or 'no column'}; the smallest group has {u['smallest_class']}, a twentieth of the rows is in groups of {u['fifth_percentile_class_size']} or fewer."})
        if figures.get("classes"):
            notes.append(f"On all columns together, {figures['classes']['distinct_classes']} rows differ and {figures['classes']['unique_rows']} are unique.")
        evidence += told.plugin_evidence(replacements, keyed)
        n = sum(figures["unchanged"].values())
        evidence.append({"id": "residual-unchanged-values", "status": "review" if n else "verified", "detail": f"{n} protected values came out as they were."})
        evidence.append({"id": "broad-residual-value-audit", "status": "review" if figures["residual"]["overlap"] else "verified", "detail": f"{figures['residual']['overlap']} of {figures['residual']['protected_values']} protected values occur somewhere in the release."})
        for e in evidence[2:]:
            if e["status"] != "info":
                (review if e["status"] == "review" else verified).append(e["detail"])
        notes += [f"{d['col']}: frequencies may tell pseudonyms apart ({d['risk']})." for d in figures["distributions"] if d["risk"] != "none"]
        if figures["effects"]:
            notes.append(f"Without {figures['effects'][0][1]}, {figures['effects'][0][0]} rows would be unique.")
    if coverage and coverage[0] < coverage[1]:
        review.append(f"Detection read {coverage[0]} of {coverage[1]} rows.")
    if detection and detection["reasons"]:
        review.append(f"The detector {detection['detector']}: {', '.join(detection['reasons'])}.")
    review.append("Checks of this kind find what they look for; other ways to tell a person remain.")
    reused = sum(d["total_values"] - d["distinct_values"] for d in (figures or {}).get("distributions", []))
    return {
        "status": "blocked" if blockers else "review", "blockers": blockers or [], "reviewItems": review, "verifiedItems": verified, "evidence": evidence, "notes": notes,
        "directIdentifiers": sum(p.kind in DIRECT for p in chosen), "quasiIdentifiers": sum(p.kind in QUASI for p in chosen),
        "strategies": {s: sum(p.strategy == s for p in chosen) for s in strategies.STRATEGIES},
        "columns": [{"index": p.index, "name": p.name, "selected": p.selected, "type": p.kind, "risk": p.risk, "strategy": p.strategy if p.selected else "released as it is", "status": "review" if not p.selected and profile.RANK[p.risk] > 0 else "ok"} for p in plans],
        "metrics": [{"label": "selected columns", "value": len(chosen)}, {"label": "columns kept as they are", "value": len(plans) - len(chosen)}, {"label": "columns that change", "value": sum(p.changes for p in plans)}, *(told.plugin_metrics(replacements, reused) if figures else [])],
        "detection": detection or told.detection_summary("disabled"),
    }


def preflight(plans: list[ColumnPlan], stats: DataFrame | None = None, rows: int = 0) -> dict:
    """What stands in the way of a run, and what asks for a look."""
    blockers = [] if any(p.selected for p in plans) else ["Nothing is selected."]
    out = report(plans, blockers=blockers)
    if stats is not None:
        m = distribution.mapping_projection(stats, rows, {p.name: p.strategy for p in plans if p.selected}).first()
        if m["review"]:
            out["reviewItems"].append(f"The maps may reach {m['entries']} entries.")
    return out


def snapshot(plans: list[ColumnPlan], fingerprint: str) -> str:
    """An analysis as JSON with a checksum, to be used again for the same source only."""
    body = json.dumps({"version": 4, "source": fingerprint, "columns": [asdict(p) for p in plans]}, sort_keys=True)
    return json.dumps({"body": body, "checksum": hashlib.sha256(body.encode()).hexdigest()})


def restored(text: str, fingerprint: str) -> list[ColumnPlan]:
    outer = json.loads(text)
    if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["checksum"]:
        raise ValueError("the snapshot was changed")
    body = json.loads(outer["body"])
    if body["source"] != fingerprint or body["version"] != 4:
        raise ValueError("the snapshot is of another source")
    plans = [ColumnPlan(**c | {"evidence": [tuple(e) for e in c["evidence"]]}) for c in body["columns"]]
    told.checked_structure(plans, [], set(), told.detection_summary("disabled"))
    return plans


def analyze_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[ColumnPlan]]:
    csvfile.validated(spark, path)
    rows = csvfile.scan(spark, path)
    columns = [c for c in rows.columns if c != "row_idx"]
    return rows, planned(rows.where(~csvfile.is_blank_row(columns)), csvfile.headers(spark, path), "row_idx")


def preview(rows: DataFrame, plans: list[ColumnPlan], seed: Column, n: int = 5, order: str = "row_idx") -> list[dict]:
    """The first rows before and after, 100 at most."""
    head = rows.orderBy(order).limit(min(2 * n, PREVIEW_MOST))
    after = {r[order]: r.asDict() for r in protected(head, plans, seed, order).collect()}
    return [{"before": r.asDict(), "after": after[r[order]]} for r in head.orderBy(order).limit(n).collect()]


def anonymize_csv(spark: SparkSession, path: str, out: str, seed: str, selected: list[int] | None = None, controls: dict[int, dict] | None = None, force: bool = False, single: bool = False) -> dict:
    rows, plans = analyze_csv(spark, path)
    plans = controlled(plans, [p.index for p in plans if p.selected] if selected is None else selected, controls)
    key = F.lit(seed)
    released = protected(rows, plans, key, "row_idx")
    csvfile.destination(path, out, force)
    csvfile.sink(released.orderBy("row_idx").drop("row_idx"), [p.name for p in plans], out, force, single)
    return report(plans, measured(rows, released, plans, "row_idx"))
