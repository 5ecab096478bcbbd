"""What a person is told beside the figures: warnings of a preview, evidence of plug-ins and keys, how detection went."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import TYPE_CHECKING

from tabveil.operators import uniqueness

if TYPE_CHECKING:
    from tabveil.plans.service import ColumnPlan

#: Types whose JSON or YAML scalars a redaction marker turns into a string.
SCALARS = {"numericValue", "numericId", "boolean", "currency", "percentage"}
POSSIBLE_NAMES = "possible person name"


def unique_share(unique: int, total: int) -> str:
    """A share of rows in per cent with one decimal; what would round to nothing is said in words."""
    if 0 < unique < 0.0005 * total:
        return "under 0.1%"
    return f"{100 * unique / max(total, 1):.1f}%"


def changes_scalar_type(p: ColumnPlan, source_path: str | None) -> bool:
    """Whether redaction may turn a number or a boolean of a JSON or YAML document into a string."""
    return p.strategy == "redact" and p.kind in SCALARS and (source_path or "").split("/")[0] in ("json", "yaml")


def keeps_mapping(p: ColumnPlan) -> bool:
    """Whether equal values have equal outputs that differ from those of other values: a histogram of them can be read."""
    if p.strategy in ("auto", "pseudonymize"):
        return p.kind not in uniqueness.PASS_THROUGH
    return p.strategy in ("tokenize", "localAi", "label")


def warnings(plans: list[ColumnPlan], risks: dict[str, str] | None = None, source_paths: dict[str, str] | None = None) -> list[tuple[int, str, str]]:
    """(index, column, text): what a preview should say of each column. risks: column -> risk of its distribution."""
    from tabveil.plans.service import DISCLOSURES

    out = []
    for p in plans:
        said = []
        if p.selected:
            if p.strategy == "passThrough":
                said.append("values are released as they are")
            elif p.strategy == "localAi":
                said.append("a local model proposes replacements; refused ones fall back to rules, never to the original")
            elif p.strategy == "label":
                said.append("equal values share a label, so that their frequencies stay visible")
            elif p.strategy == "mask":
                said.append("lengths of words and the spaces between them stay visible")
            elif changes_scalar_type(p, (source_paths or {}).get(p.name)):
                said.append("a marker in place of a number or boolean may change the scalar's type in the document")
            elif p.strategy in ("auto", "pseudonymize") and p.kind in uniqueness.PASS_THROUGH:
                said.append(f"type {p.kind} passes through unchanged")
            elif p.strategy in ("auto", "pseudonymize") and p.kind in DISCLOSURES:
                said.append(f"what a replacement keeps: {DISCLOSURES[p.kind]}")
            if keeps_mapping(p) and (risks or {}).get(p.name, "none") != "none":
                said.append(f"frequencies may tell pseudonyms apart ({risks[p.name]})")
        elif any(e[1] == POSSIBLE_NAMES for e in p.evidence):
            said.append("values look like names of people, or of places and products; left out, they are released as they are")
        out += [(p.index, p.name, f"{p.name}: {text}.") for text in said]
    return out


@dataclass
class Replacements:
    """Counts of a plug-in's answers over a run."""

    requests: int = 0
    accepted: int = 0
    fallbacks: int = 0
    rejections: dict[str, int] = field(default_factory=dict)

    @property
    def rejected(self) -> int:
        return sum(self.rejections.values())


def plugin_evidence(r: Replacements | None = None, keyed: dict[str, int] | None = None) -> list[dict]:
    """The rows local-ai-validation and keyed-tokenization of a report, each only where something of its kind ran."""
    out = []
    if r and r.requests:
        why = ", ".join(f"{n} {reason}" for reason, n in sorted(r.rejections.items()) if n)
        detail = f"{r.requests} values asked, {r.accepted} replacements accepted, {r.rejected} refused, {r.fallbacks} left to rules." + (f" Refused: {why}." if why else "")
        out.append({"id": "local-ai-validation", "status": "review" if r.rejected or r.fallbacks else "verified", "detail": detail})
    if keyed and sum(keyed.values()):
        names = ", ".join(c for c, n in keyed.items() if n)
        out.append({"id": "keyed-tokenization", "status": "info", "detail": f"{sum(keyed.values())} distinct values of {names} have tokens of a key that is not in this report; releases with the same key can be linked, and without it the tokens cannot be made again."})
    return out


def plugin_metrics(r: Replacements | None, reused: int) -> list[dict]:
    """Metrics of a run: cells that took the output of an earlier equal value, and accepted replacements."""
    out = [{"label": "repeated values that reuse an output", "value": reused}]
    return out + ([{"label": "replacements accepted", "value": f"{r.accepted}/{r.requests}"}] if r and r.requests else [])


def detection_summary(status: str, detector: str | None = None, version: str | None = None, examined: int = 0, total: int | None = None, oversized: int = 0, accepted: int = 0, rejections: dict[str, int] | None = None, message: str | None = None) -> dict:
    """How the detection of a run went. status of the plug-in: disabled, completed, incomplete or failed; the rules themselves always complete."""
    if status not in ("disabled", "completed", "incomplete", "failed"):
        raise ValueError(f"no status {status}")
    out = {"rules": "completed", "plugin": status, "detector": None, "version": None, "examined": 0, "eligible": 0, "oversized": 0, "accepted": 0, "rejected": 0, "reasons": [], "message": None}
    if status == "disabled":
        return out
    out |= {"detector": detector, "examined": examined, "eligible": examined if status != "incomplete" or total is None else total}
    if status == "failed":
        return out | {"reasons": ["detectorFailed"], "message": message}
    rejected = sum((rejections or {}).values())
    out |= {"version": version, "accepted": accepted, "rejected": rejected, "reasons": ["candidateRejected"] if rejected else []}
    if status == "incomplete":
        out |= {"oversized": oversized, "message": f"The plug-in read {examined} of {out['eligible']} cells; {oversized} were too large for it."}
    return out


@dataclass(frozen=True)
class Confirmed:
    """A span that a plug-in found and a person confirmed; start and end in code points."""

    id: str
    column: int
    row: int
    start: int
    end: int
    kind: str
    sample: str
    value: str
    detector: str


def checked_structure(columns: list[ColumnPlan], confirmed: list[Confirmed], findings: set[tuple], summary: dict) -> None:
    """ValueError unless a snapshot is whole: columns in place, each confirmed span once, inside its sample, apart from the others, and with a finding of its own.

    findings: (column, row, start, end, kind, value, detector).
    """
    if [c.index for c in columns] != list(range(len(columns))):
        raise ValueError("columns are out of place")
    if confirmed and (summary["plugin"] not in ("completed", "incomplete") or not summary["detector"]):
        raise ValueError("confirmed spans without a detector that ran")
    ids, places, last = set(), set(), {}
    for c in sorted(confirmed, key=lambda c: (c.column, c.row, c.start, c.end)):
        place = (c.column, c.row, c.start, c.end, c.kind)
        if c.id in ids or place in places:
            raise ValueError("a span is there twice")
        if not 0 <= c.column < len(columns):
            raise ValueError("a span of no column")
        if not 0 <= c.start < c.end <= len(c.sample) or c.sample[c.start : c.end] != c.value or c.detector != f"local:{summary['detector']}":
            raise ValueError("a span does not fit its sample")
        if (c.column, c.row, c.start, c.end, c.kind, c.value, c.detector) not in findings:
            raise ValueError("a span without a finding")
        if c.start < last.get((c.column, c.row), 0):
            raise ValueError("spans overlap")
        ids.add(c.id)
        places.add(place)
        last[c.column, c.row] = c.end


def as_rows(confirmed: list[Confirmed]) -> list[dict]:
    return [asdict(c) for c in confirmed]
