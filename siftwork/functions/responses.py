"""Reading of structured answers: rows of a JSON response with defaults, or signs found in a text that isn't JSON.

A kind of response is declared once: the key of its array, its fields with their defaults (a field
without one is required), the values that an enumeration knows, and what words in a plain text stand for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.extract import is_json


@dataclass(frozen=True)
class Field:
    """A field of a row; ``kind`` is string, double or array<string>. Values outside ``known`` become the default."""

    name: str
    kind: str = "string"
    default: object = None
    required: bool = False
    known: Mapping[str, str] | None = None
    key: str | None = None


@dataclass(frozen=True)
class Sign:
    """If one of the words occurs in a text, it stands for this row."""

    words: Sequence[str]
    row: Mapping[str, object]


@dataclass(frozen=True)
class Response:
    key: str | None
    fields: Sequence[Field]
    signs: Sequence[Sign] = field(default_factory=tuple)

    def _schema(self) -> str:
        inner = ",".join(f"`{f.key or f.name}`:{f.kind}" for f in self.fields)
        return f"struct<{inner}>" if self.key is None else f"struct<`{self.key}`:array<struct<{inner}>>>"

    def _type(self) -> str:
        return "struct<" + ",".join(f"`{f.name}`:{f.kind}" for f in self.fields) + ">"

    def _value(self, f: Field, given: Column) -> Column:
        if f.known is not None:
            known = F.lit(None).cast("string")
            for k, v in f.known.items():
                known = F.when(given == k, v).otherwise(known)
            given = known
        default = F.array(*[F.lit(x) for x in f.default]) if isinstance(f.default, list | tuple) else F.lit(f.default)
        return F.coalesce(given, default.cast(f.kind)).alias(f.name)

    def _made(self, row: Mapping[str, object]) -> Column:
        values = []
        for f in self.fields:
            v = row.get(f.name, f.default)
            made = F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else F.lit(v)
            values.append(made.cast(f.kind).alias(f.name))
        return F.struct(*values).cast(self._type())

    def rows(self, text: Column) -> Column:
        """The rows that a response states; null for a null response."""
        parsed = F.from_json(text, self._schema())
        need = [f.key or f.name for f in self.fields if f.required]
        made = lambda r: F.struct(*[self._value(f, r[f.key or f.name]) for f in self.fields]).cast(self._type())
        if self.key is None:
            found = F.array(made(parsed))
        else:

            def whole(r: Column) -> Column:
                out = r.isNotNull()
                for k in need:
                    out = out & r[k].isNotNull()
                return out

            items = F.filter(parsed[self.key], whole)
            found = F.coalesce(F.transform(items, made), F.array().cast(f"array<{self._type()}>"))
        said = [F.when(_any(s.words, text), self._made(s.row)) for s in self.signs]
        from_text = F.array_compact(F.array(*said)) if said else F.array().cast(f"array<{self._type()}>")
        return F.when(is_json(text), found).when(text.isNotNull(), from_text)


def _any(words: Sequence[str], text: Column) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


_LEVELS = {"low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}

#: The kinds of response.
RELATIONSHIPS = Response(
    "semantic_relationships",
    [Field("kind", default="Uses", required=True, key="relationship_type", known={k: k.capitalize() for k in ("uses", "depends", "extends", "implements", "invokes", "aggregates", "composes")}), Field("source", required=True), Field("target", required=True), Field("strength", "double", 0.5), Field("description", default="AI-detected relationship")],
    [Sign(("uses", "depends"), {"kind": "Uses", "source": "detected_function", "target": "dependency_function", "strength": 0.6, "description": "Text-based relationship detection"})],
)
CHANGES = Response(
    "conceptual_changes",
    [Field("concept", required=True), Field("change_type", required=True), Field("impact", required=True, key="impact_description")],
    [Sign(("data flow", "workflow"), {"concept": "Data flow", "change_type": "Modified", "impact": "data flow"}), Sign(("security", "authentication"), {"concept": "Security", "change_type": "Modified", "impact": "security"}), Sign(("api", "interface"), {"concept": "Interface", "change_type": "Modified", "impact": "interface"})],
)
IMPLICATIONS = Response(
    "architectural_implications",
    [Field("component", required=True), Field("implication", required=True), Field("severity", default="Medium", known=_LEVELS)],
    [Sign(("service", "layer"), {"component": "Service layer", "implication": "service layer affected", "severity": "Medium"}), Sign(("component", "module"), {"component": "Components", "implication": "components affected", "severity": "Low"}), Sign(("database", "storage"), {"component": "Storage", "implication": "storage affected", "severity": "High"})],
)
RECOMMENDATIONS = Response(
    "recommendations",
    [Field("description", required=True), Field("kind", default="Refactor", key="type"), Field("priority", default="Medium", known=_LEVELS), Field("effort", default="Medium", known=_LEVELS), Field("steps", "array<string>", ["Review and implement"])],
    [Sign(("test", "testing"), {"description": "Add tests", "kind": "Test", "priority": "High"}), Sign(("review", "check"), {"description": "Review the change", "kind": "Review", "priority": "Medium"})],
)
CASCADES = Response(
    "cascade_effects",
    [Field("component", required=True), Field("function", required=True), Field("description", required=True), Field("kind", default="Indirect", key="type", known={"direct": "Direct", "indirect": "Indirect", "cascading": "Cascading"}), Field("level", default="Medium", key="impact", known=_LEVELS)],
    [Sign(("cascade", "ripple"), {"component": "Dependents", "function": "dependents", "description": "Cascade effects named", "kind": "Indirect"}), Sign(("direct", "immediate"), {"component": "Callers", "function": "callers", "description": "Direct effects named", "kind": "Direct", "level": "High"})],
)
RISK = Response(
    None,
    [Field("overall", default="Medium", key="overall_risk", known=_LEVELS), Field("breaking", "double", 0.3, key="breaking_change_probability"), Field("regression", "double", 0.2, key="regression_risk"), Field("performance", "double", 0.1, key="performance_impact"), Field("security", "array<string>", ["No security implications detected"], key="security_implications"), Field("mitigation", "array<string>", ["Run comprehensive test suite"], key="mitigation_strategies")],
)
DOMAINS = Response(None, [Field("domains", "array<string>", [], key="affected_domains"), Field("effects", "array<string>", [], key="cross_domain_effects")])
SUGGESTIONS = Response("suggestions", [Field("kind", default="Performance", key="type"), Field("description", default="AI-generated suggestion"), Field("benefit", default="Improved code quality"), Field("effort", default="Medium", known=_LEVELS), Field("priority", default="Medium", known=_LEVELS)])
SEMANTICS = Response(None, [Field("purpose", default="AI-analyzed function"), Field("behavior", default=""), Field("concepts", "array<string>", []), Field("relevance", "double", 0.7)])


def risk_from_text(text: Column) -> Column:
    """Risk, breaking and regression probability that a plain text's words stand for, the gravest first."""
    graded = lambda overall, breaking, regression: F.struct(F.lit(overall).alias("overall"), F.lit(breaking).alias("breaking"), F.lit(regression).alias("regression"))
    level = F.when(_any(("critical", "breaking"), text), graded("High", 0.7, 0.5)).when(_any(("high risk", "dangerous"), text), graded("High", 0.5, 0.4)).when(_any(("medium risk", "moderate"), text), graded("Medium", 0.3, 0.2)).otherwise(graded("Low", 0.1, 0.1))
    return F.struct(level["overall"].alias("overall"), level["breaking"].alias("breaking"), level["regression"].alias("regression"), F.when(_any(("performance", "slow"), text), 0.3).otherwise(0.1).alias("performance"), _any(("security", "vulnerability"), text).alias("security"))


def named_functions(text: Column, most: int = 5) -> Column:
    """``related_functions`` of a JSON response, else the first words with ``Function`` in them or ``()`` behind them, without these."""
    listed = F.from_json(text, "struct<related_functions:array<string>>")["related_functions"]
    spoken = F.filter(F.split(text, r"\s+"), lambda w: F.contains(w, F.lit("Function")) | F.endswith(w, F.lit("()")))
    bare = F.filter(F.transform(spoken, lambda w: F.replace(F.replace(w, F.lit("()"), F.lit("")), F.lit("Function"), F.lit(""))), lambda w: w != "")
    return F.coalesce(listed, F.slice(bare, 1, most))


def embedding_of(text: Column, dim: int) -> Column:
    """The vector that a response states, as an array or under ``embedding``; null unless it has ``dim`` numbers."""
    v = F.coalesce(F.from_json(text, "array<double>"), F.from_json(text, "struct<embedding:array<double>>")["embedding"])
    return F.when((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()), v)


def bullet_names(text: Column) -> Column:
    """Names of ``- name: ...`` lines."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*-\s*([^:\n]*?)\s*(?::.*)?$"), F.lit(1))
