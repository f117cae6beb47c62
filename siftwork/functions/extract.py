"""Facts that a file's text states line by line, as columns: imports, exports, routes, guards, state, style names.

Each gives an array (empty if the text has none) or a value; a null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import contains_any, lines


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _trimmed(text: Column) -> Column:
    return F.transform(lines(text), lambda x: F.trim(x))


def imports(text: Column) -> Column:
    """Modules of lines ``import ... from 'module'``."""
    return _all(text, r"(?m)^[ \t]*import [^\n]*? from ['\"]([^'\"\n]+)['\"]")


def imported_names(text: Column) -> Column:
    """Names in the braces of import lines, in order, each as often as it is imported."""
    inner = _all(text, r"(?m)^[ \t]*import[^{\n]*\{([^}\n]*)\}[^\n]*from")
    return F.filter(F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def exports(text: Column) -> Column:
    """Names of exported classes, functions and constants."""
    return _all(text, r"(?m)^[ \t]*export (?:class|function|const)[ \t]+([^\s({=:<;/]+)")


def plain_functions(text: Column) -> Column:
    """Names after the word ``function``."""
    return _all(text, r"(?m)(?:^|[^\w$])function\s+([\w$]+)\s*\(")


def receivers(text: Column) -> Column:
    """Of each line, the name before its first dot, each once."""
    names = F.transform(_trimmed(text), lambda x: F.regexp_extract(x, r"^[^.]*?(\w+)\.", 1))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def awaited(text: Column) -> Column:
    """Objects whose method a line awaits, each once."""
    return F.array_distinct(_all(text, r"await (\w+)\."))


def dependencies(text: Column) -> Column:
    """What a context depends on: imported names (strength 0.8), objects called (0.6), objects awaited (0.7).

    Imported names keep their repeats; of the others each target comes once, and not if it was named before.
    """
    item = "struct<kind:string,target:string,strength:double>"
    made = lambda names, kind, strength: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target"), F.lit(strength).alias("strength")).cast(item))
    named = imported_names(text)
    called = F.array_except(receivers(text), named)
    then = F.array_except(F.array_except(awaited(text), named), called)
    return F.concat(made(named, "Import", 0.8), made(called, "FunctionCall", 0.6), made(then, "FunctionCall", 0.7))


def style_variables(text: Column) -> Column:
    """Names of ``$variable:`` lines; null for a text without ``$``."""
    return F.when(F.contains(text, F.lit("$")), _all(text, r"(?m)^[ \t]*(\$[^:\s]+)[ \t]*:"))


def style_mixins(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@mixin")), _all(text, r"(?m)^[ \t]*@mixin ([^\s(]+)"))


def custom_properties(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, r"(--[\w-]+)[ \t]*:")))


def class_names(text: Column) -> Column:
    return _all(text, r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+)")


def bracket_list(text: Column, key: str) -> Column:
    """The names in the first ``key: [...]``; empty without one."""
    inner = F.regexp_extract(text, rf"\b{key}\s*:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def module_info(text: Column) -> Column:
    """Class and lists of a module decorator; null without class or decorator."""
    keys = ("imports", "exports", "declarations", "providers", "bootstrap")
    name = F.get(class_names(text), 0)
    info = F.struct(name.alias("name"), *[bracket_list(text, k).alias(k) for k in keys], F.contains(text, F.lit("bootstrap:")).alias("is_root"), F.contains(text, F.lit("CommonModule")).alias("is_shared"))
    return F.when(F.contains(text, F.lit("@NgModule")) & name.isNotNull(), info)


def component_info(text: Column) -> Column:
    """Selector, inputs, outputs and lifecycle hooks of a component; null without its decorator."""
    hooks = F.array_distinct(_all(text, r"(?m)^[ \t]*(ng(?:OnInit|OnDestroy|OnChanges|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked))\s*\("))
    info = F.struct(
        F.nullif(F.regexp_extract(text, r"selector:\s*['\"]([^'\"]+)['\"]", 1), F.lit("")).alias("selector"),
        _all(text, r"@Input\([^)]*\)\s*(?:\w+\s+)*?(\w+)\s*[!?]?\s*[:=;]").alias("inputs"),
        _all(text, r"@Output\([^)]*\)\s*(?:\w+\s+)*?(\w+)\s*[!?]?\s*[:=;]").alias("outputs"),
        hooks.alias("hooks"),
    )
    return F.when(F.contains(text, F.lit("@Component")), info)


def injected(text: Column) -> Column:
    """What ``inject(...)`` asks for."""
    return F.transform(_all(text, r"inject\(([^)\n]*)\)"), lambda x: F.trim(x))


def constructor_types(text: Column) -> Column:
    """Types of the constructor's private parameters."""
    inner = F.regexp_extract(text, r"constructor\s*\(([^)]*)\)", 1)
    return _all(inner, r"private\s+(?:readonly\s+)?\w+\s*:\s*([\w.<>\[\]]+)")


def guard_info(path: Column, text: Column) -> Column:
    """Name, kind and dependencies of a route guard; null for a path without ``.guard.``."""
    kinds = {"CanActivateFn": "CanActivate", "CanDeactivateFn": "CanDeactivate", "CanLoadFn": "CanLoad", "ResolveFn": "Resolve", "CanMatchFn": "CanMatch"}
    kind = F.lit("CanActivate")
    for sign, name in reversed(kinds.items()):
        kind = F.when(F.contains(text, F.lit(sign)), name).otherwise(kind)
    name = F.regexp_extract(path, r"([^/]*?)(?:\.guard)?\.[^./]+$", 1)
    return F.when(F.contains(path, F.lit(".guard.")) & text.isNotNull(), F.struct(name.alias("name"), kind.alias("kind"), injected(text).alias("dependencies")))


STATE_KINDS = ("BehaviorSubject", "ReplaySubject", "AsyncSubject", "Subject")


def state_properties(text: Column) -> Column:
    """Lines that assign a subject or signal: name, kind, whether private (so unless ``readonly``)."""

    def of(line: Column) -> Column:
        kind = F.coalesce(*[F.when(F.contains(line, F.lit(k)), k) for k in STATE_KINDS], F.when(F.contains(line, F.lit("writableSignal(")), "WritableSignal"), F.when(F.contains(line, F.lit("signal(")), "Signal"), F.when(F.contains(line, F.lit("computed(")), "ComputedSignal"))
        name = F.nullif(F.regexp_extract(line, r"^[^=]*?(\S+)\s*=", 1), F.lit(""))
        return F.struct(name.alias("name"), kind.alias("kind"), (F.contains(line, F.lit("private ")) | ~F.contains(line, F.lit("readonly "))).alias("is_private"))

    return F.filter(F.transform(_trimmed(text), of), lambda s: s["kind"].isNotNull() & s["name"].isNotNull())


def observables(text: Column) -> Column:
    """Lines that declare an observable by a ``$`` name, by type, by the way it is made or as a computed signal: name and whether ``readonly``."""

    def of(line: Column) -> Column:
        by_sign = F.contains(line, F.lit("$")) & contains_any(line, ("=", "asObservable", "pipe"))
        by_type = F.contains(line, F.lit("=")) & F.rlike(line, F.lit(r": (?:Observable|BehaviorSubject|Subject|ReplaySubject|AsyncSubject)<"))
        by_source = F.contains(line, F.lit("=")) & F.rlike(line, F.lit(r"asObservable\(\)|\.pipe\(|new (?:Observable|BehaviorSubject|Subject)\(|this\.http\.(?:get|post|put|delete)|computed\("))
        name = F.when(by_sign, F.regexp_extract(line, r"^[^$]*?([^\s$]*\$)", 1)).when(by_type, F.regexp_extract(line, r"^[^:]*?([^\s:]+)\s*:", 1)).when(by_source, F.regexp_extract(line, r"^[^=]*?(\S+)\s*=", 1))
        return F.struct(F.nullif(name, F.lit("")).alias("name"), F.contains(line, F.lit("readonly ")).alias("is_readonly"))

    return F.filter(F.transform(_trimmed(text), of), lambda s: s["name"].isNotNull())


def is_json(text: Column) -> Column:
    """Whether a text is JSON; an object that names a key twice is, too."""
    return F.try_parse_json(text).isNotNull() | F.from_json(text, "map<string,string>").isNotNull()


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, if that is JSON; else null."""
    part = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(is_json(part), part)


def confidence(text: Column, missing: float = 0.8, invalid: float = 0.7) -> Column:
    """``confidence`` of a JSON response; ``missing`` if it has none, ``invalid`` if it isn't JSON."""
    given = F.get_json_object(text, "$.confidence").try_cast("double")
    return F.when(~is_json(text), F.lit(invalid)).otherwise(F.coalesce(given, F.lit(missing)))


def manifest_dependencies(text: Column) -> Column:
    """The dependency maps of a package manifest in JSON, merged; null if it isn't one."""
    m = F.from_json(text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    empty = F.create_map().cast("map<string,string>")
    dev = F.map_filter(F.coalesce(m["devDependencies"], empty), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(m["dependencies"], empty), k), F.lit(False)))
    return F.when(m.isNotNull(), F.map_concat(F.coalesce(m["dependencies"], empty), dev))


def framework(packages: Column) -> Column:
    has = lambda k: F.coalesce(F.map_contains_key(packages, F.lit(k)), F.lit(False))
    return F.when(has("@angular/core"), "Angular").when(has("react"), "React").when(has("vue"), "Vue").otherwise("Unknown")


#: Parts of the names of methods that keep state, and what the body of such a method does.
STATE_WORDS = ("update", "set", "clear", "reset", "init", "store", "load", "refresh", "state", "auth", "user", "loading", "next", "emit", "trigger")
STATE_CALLS = (".next(", ".emit(", ".update(", "BehaviorSubject", "Subject")


def keeps_state(name: Column, text: Column, reach: int = 10) -> Column:
    """Whether a method keeps state: by a word in its name, or a call within ``reach`` lines from where the name first stands before a bracket."""
    called = F.concat(name, F.lit("("))
    at = F.instr(text, called)
    body = F.array_join(F.slice(lines(F.substring(text, at, F.length(text))), 1, reach), " ")
    return contains_any(F.lower(name), STATE_WORDS) | F.when(at > 0, contains_any(body, STATE_CALLS)).otherwise(False)


def state_methods(text: Column) -> Column:
    """Names before the bracket of lines that open or declare a method that keeps state, in order."""
    heads = F.filter(_trimmed(text), lambda x: ~contains_any(x, ("fn ", "function ")) & F.contains(x, F.lit("(")) & contains_any(x, ("):", ") {")))
    names = F.transform(heads, lambda x: F.regexp_extract(F.substring_index(x, "(", 1), r"(\S+)\s*$", 1))
    return F.filter(names, lambda n: (n != "") & keeps_state(n, text))


def pipe_info(text: Column) -> Column:
    """Class, pipe name, whether pure and standalone, parameters and return type of ``transform`` of a pipe; null without its decorator."""
    head = r"(?s)transform\s*\(([^)]*)\)\s*(?::\s*([^{;]*?))?\s*\{"
    info = F.struct(
        F.get(class_names(text), 0).alias("name"),
        F.nullif(F.regexp_extract(text, r"(?s)@Pipe\s*\(\s*\{[^}]*?name:\s*['\"]([^'\"]+)['\"]", 1), F.lit("")).alias("pipe_name"),
        (~F.rlike(text, F.lit(r"pure:\s*false"))).alias("is_pure"),
        F.rlike(text, F.lit(r"standalone:\s*true")).alias("is_standalone"),
        F.filter(F.transform(F.split(F.regexp_extract(text, head, 1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("parameters"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract(text, head, 2)), F.lit("")), F.lit("any")).alias("returns"),
    )
    return F.when(F.contains(text, F.lit("@Pipe")), info)


def transform_signature(info: Column) -> Column:
    return F.concat(F.lit("transform("), F.array_join(info["parameters"], ", "), F.lit("): "), info["returns"])


#: What a pipe is used for, by a part of its name.
PIPE_USES = {
    "date": ("Date formatting", "Locale-specific dates"),
    "currency": ("Currency formatting", "Locale-specific currency"),
    "upper": ("Text transformation", "String manipulation"),
    "lower": ("Text transformation", "String manipulation"),
    "async": ("Async data handling", "Observable transformation"),
}
PIPE_USE = ("Data transformation", "Template formatting")


def pipe_uses(name: Column) -> Column:
    """Two uses of a pipe, by the first part that its name has."""
    out = F.array(*map(F.lit, PIPE_USE))
    for part, uses in reversed(PIPE_USES.items()):
        out = F.when(F.contains(F.lower(name), F.lit(part)), F.array(*map(F.lit, uses))).otherwise(out)
    return F.when(name.isNotNull(), out)
