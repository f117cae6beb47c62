"""What names, types and attributes usually stand for: ordered rules, the first that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Sequence[str], str]

#: Fixed values: (how to compare, words, what they stand for).
FUNCTION_NAMES: Sequence[Rule] = (
    ("starts", ("new",), "constructor"),
    ("starts", ("create",), "factory method"),
    ("starts", ("build",), "builder pattern"),
    ("starts", ("get", "fetch"), "accessor/getter"),
    ("starts", ("set", "update"), "mutator/setter"),
    ("starts", ("is", "has"), "predicate/boolean check"),
    ("starts", ("validate", "check"), "validation"),
    ("starts", ("parse", "decode"), "parsing/deserialization"),
    ("starts", ("serialize", "encode"), "serialization"),
    ("starts", ("load", "read"), "data loading"),
    ("starts", ("save", "write"), "data persistence"),
    ("starts", ("send", "emit"), "event/message dispatch"),
    ("starts", ("handle", "process"), "event/data processing"),
    ("starts", ("add", "insert"), "collection addition"),
    ("starts", ("remove", "delete"), "collection removal"),
    ("starts", ("find", "search"), "data retrieval"),
    ("starts", ("filter", "select"), "data filtering"),
    ("starts", ("map", "transform"), "data transformation"),
    ("starts", ("reduce", "aggregate"), "data aggregation"),
    ("contains", ("async", "await"), "asynchronous operation"),
    ("else", (), "general purpose function"),
)
#: Fixed values, as above.
PARAMETER_NAMES: Sequence[Rule] = (
    ("is", ("self",), "instance reference"),
    ("is", ("id", "uuid", "key"), "identifier"),
    ("contains", ("path", "file"), "file path"),
    ("contains", ("config", "options"), "configuration"),
    ("contains", ("data", "content"), "data payload"),
    ("contains", ("query", "search"), "search parameter"),
    ("contains", ("index", "pos"), "position/index"),
    ("contains", ("size", "len", "count"), "size/quantity"),
    ("contains", ("callback", "handler"), "callback function"),
    ("else", (), "parameter"),
)
#: Fixed values, as above.
TYPE_NAMES: Sequence[Rule] = (
    ("is", ("Result<T, E>", "Result<()>"), "error-handling result"),
    ("is", ("Option<T>",), "optional value"),
    ("is", ("Vec<T>", "Vec<_>"), "dynamic array/collection"),
    ("is", ("HashMap<K, V>", "BTreeMap<K, V>"), "key-value mapping"),
    ("is", ("HashSet<T>", "BTreeSet<T>"), "unique value collection"),
    ("is", ("&str", "String"), "text/string data"),
    ("is", ("&[T]", "Box<[T]>"), "array slice/buffer"),
    ("is", ("Box<T>", "Rc<T>", "Arc<T>"), "heap-allocated/shared data"),
    ("is", ("&mut T",), "mutable reference"),
    ("is", ("&T",), "immutable reference"),
    ("is", ("PathBuf", "&Path"), "filesystem path"),
    ("is", ("Duration", "Instant"), "time measurement"),
    ("is", ("Uuid",), "unique identifier"),
    ("starts", ("fn(",), "function pointer/closure"),
    ("contains", ("Future",), "async computation"),
    ("contains", ("Stream",), "async data stream"),
    ("contains", ("Iterator",), "lazy data sequence"),
    ("contains", ("Error",), "error type"),
    ("contains", ("Config",), "configuration data"),
    ("ends", ("Builder",), "builder pattern object"),
    ("else", (), "custom type"),
)
#: Fixed values, as above.
DERIVES: Sequence[Rule] = (
    ("is", ("Debug",), "debug printing support"),
    ("is", ("Clone",), "value cloning capability"),
    ("is", ("Copy",), "trivial copying (stack-only)"),
    ("is", ("PartialEq", "Eq"), "equality comparison"),
    ("is", ("PartialOrd", "Ord"), "ordering/sorting support"),
    ("is", ("Hash",), "hash map key capability"),
    ("is", ("Serialize", "Deserialize"), "serde serialization"),
    ("is", ("Default",), "default value construction"),
    ("is", ("Display",), "formatted display output"),
    ("else", (), "code generation"),
)
#: Fixed values, as above.
ATTRIBUTES: Sequence[Rule] = (
    ("contains", ("derive",), "automatic trait implementation"),
    ("contains", ("cfg",), "conditional compilation"),
    ("contains", ("allow", "deny"), "lint control"),
    ("contains", ("repr",), "memory layout specification"),
    ("contains", ("doc",), "documentation metadata"),
    ("contains", ("test",), "test function marker"),
    ("contains", ("bench",), "benchmark function"),
    ("contains", ("inline",), "inlining hint"),
    ("contains", ("deprecated",), "deprecation warning"),
    ("else", (), "compiler directive"),
)
#: Fixed values, as above.
FIELD_NAMES: Sequence[Rule] = (
    ("is", ("id", "uuid", "key"), "unique identifier"),
    ("is", ("name", "title", "label"), "display name"),
    ("is", ("description", "desc", "summary"), "descriptive text"),
    ("is", ("config", "settings", "options"), "configuration data"),
    ("is", ("data", "content", "payload"), "primary data"),
    ("is", ("status", "state", "phase"), "state information"),
    ("is", ("count", "size", "length", "total"), "quantity/measurement"),
    ("is", ("path", "url", "uri", "location"), "resource location"),
    ("is", ("timestamp", "created_at", "updated_at"), "temporal data"),
    ("is", ("version", "revision", "build"), "version information"),
    ("ends", ("_id", "_key"), "foreign identifier"),
    ("starts", ("is_", "has_", "can_"), "boolean flag"),
    ("contains", ("cache",), "cached data"),
    ("contains", ("buffer",), "temporary storage"),
    ("contains", ("index",), "position/lookup data"),
    ("contains", ("handler", "callback"), "function reference"),
    ("else", (), "data field"),
)
#: Fixed values, as above.
CLUSTER_NAMES: Sequence[Rule] = (("contains", ("get", "fetch"), "Data Access"), ("contains", ("validate", "check"), "Validation"), ("contains", ("format", "transform"), "Transformation"), ("else", (), "Utility"))


def _holds(how: str, text: Column, word: str) -> Column:
    w = F.lit(word)
    return {"is": lambda: text == w, "starts": lambda: F.startswith(text, w), "ends": lambda: F.endswith(text, w), "contains": lambda: F.contains(text, w)}[how]()


def by_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """What the first rule that holds gives; null for a null text."""
    out = F.lit(None).cast("string")
    for how, words, label in reversed(rules):
        if how == "else":
            out = F.when(text.isNotNull(), label)
            continue
        hit = F.lit(False)
        for w in words:
            hit = hit | _holds(how, text, w)
        out = F.when(hit, label).otherwise(out)
    return out


def cluster_kind(names: Column) -> Column:
    """The kind of a group by its members' names: the first kind that any of them shows."""
    out = F.lit(CLUSTER_NAMES[-1][2])
    for how, words, label in reversed(CLUSTER_NAMES[:-1]):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(F.bool_or(_holds(how, names, w)), F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


def rules_sql(text: str, rules: Sequence[Rule]) -> str:
    """The same as a CASE of SQL."""
    test = {"is": "{t} = '{w}'", "starts": "starts_with({t}, '{w}')", "ends": "ends_with({t}, '{w}')", "contains": "contains({t}, '{w}')"}
    parts = [f"WHEN {text} IS NULL THEN NULL"]
    for how, words, label in rules:
        parts.append(f"ELSE '{label}'" if how == "else" else "WHEN " + " OR ".join(test[how].format(t=text, w=w) for w in words) + f" THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def function_text(name: Column, parameters: Column, returns: Column, is_async: Column, modifiers: Column, path: Column, body: Column) -> Column:
    """A function as a text to search: signature, file, purpose, body, and what parameters and return type stand for; parts that are missing are left out."""
    given = F.coalesce(F.size(parameters), F.lit(0)) > 0
    kind = lambda p: F.coalesce(p["param_type"], F.lit(""))
    pairs = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), kind(p))), ", ")
    known = F.filter(F.coalesce(modifiers, F.array().cast("array<string>")), lambda m: m.isin("pub", "unsafe", "const"))
    before = F.array_join(F.concat(F.when(F.coalesce(is_async, F.lit(False)), F.array(F.lit("async"))).otherwise(F.array().cast("array<string>")), known), " ")
    said = F.concat(F.lit("fn "), name, F.when(given, F.concat(F.lit("("), pairs, F.lit(")"))).otherwise(""), F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit(" -> "), returns)).otherwise(""))

    def told(p: Column) -> Column:
        purpose = by_rules(p["name"], PARAMETER_NAMES)
        return F.concat(p["name"], F.lit(": "), kind(p), F.lit(" ("), F.when(purpose != "parameter", purpose).otherwise(by_rules(kind(p), TYPE_NAMES)), F.lit(")"))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("FUNCTION: "), F.when(before != "", F.concat(before, F.lit(" "), said)).otherwise(said)),
        F.concat(F.lit("FILE: "), path),
        F.concat(F.lit("PURPOSE: "), by_rules(F.lower(name), FUNCTION_NAMES)),
        F.when(body != "", F.concat(F.lit("IMPLEMENTATION:\n"), body)),
        F.when(given, F.concat(F.lit("PARAMETERS: "), F.array_join(F.transform(parameters, told), ", "))),
        F.when(returns != "", F.concat(F.lit("RETURNS: "), returns, F.lit(" ("), by_rules(returns, TYPE_NAMES), F.lit(")"))),
    )
