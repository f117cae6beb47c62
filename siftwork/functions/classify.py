"""Rule classifiers of paths and contents, as columns. Rules apply in order; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import contains_any, count_of, line_count

#: The language of an extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "java": "java", "cpp": "cpp", "c": "c", "go": "go"}
#: Extensions that a scan keeps, and what it leaves out wherever it stands in a path.
SCANNED = ("ts", "js", "scss", "css", "json", "rs", "toml")
IGNORED_PARTS = ("node_modules", ".git", "dist", "build", "target")
IGNORED_ENDS = (".min.js", ".min.css")
#: Tokens that open a decision, and the declarations that count towards complexity.
DECISIONS = ("if ", "else ", "for ", "while ", "switch ", "case ", "catch ", " && ", " || ")
DECLARATIONS = ("fn ", "struct ", "enum ", "trait ", "impl ", "function ", "class ", "interface ", "async ")
#: Weights of a weighted complexity.
WEIGHTED = {"if ": 0.3, "match ": 0.5, "for ": 0.4, "while ": 0.4, "loop ": 0.4, "async ": 0.2, ".await": 0.1, "Result<": 0.2, "Option<": 0.1, "?": 0.1, "<T>": 0.3, "impl<": 0.3}
#: What shows error handling, a changed request, a changed response, and reactive code.
ERROR_SIGNS = ("catchError", "HttpErrorResponse", "error.status", "throwError")
REQUEST_SIGNS = ("req.clone", "setHeaders", "setParams", "withCredentials", "req.url")
RESPONSE_SIGNS = ("map(", "tap(", "response.", "res.body")
PATTERN_WORDS = ("async", "await", "Promise", "Observable", "Subject", "BehaviorSubject")
USAGE = {"async": "Asynchronous operation", "Promise": "Promise-based", "Observable": "Observable pattern", "@Injectable": "Dependency injection", "@Component": "Angular component"}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; empty if there is none or the name begins with it."""
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def language(path: Column) -> Column:
    """The language that the extension stands for, null if it is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.nullif(extension(path), F.lit("")))


def is_ignored(path: Column) -> Column:
    out = contains_any(path, IGNORED_PARTS)
    for end in IGNORED_ENDS:
        out = out | F.endswith(path, F.lit(end))
    return out


def is_scanned(path: Column) -> Column:
    return ~is_ignored(path) & extension(path).isin(*SCANNED)


def is_test_path(path: Column) -> Column:
    """``test`` or ``spec`` anywhere, even within a word."""
    return contains_any(path, ("test", "spec"))


def _rust_path(path: Column, folder: str) -> Column:
    return F.contains(path, F.lit(f"/{folder}/")) | F.startswith(path, F.lit(f"{folder}/"))


def path_type(path: Column) -> Column:
    """The type that a path alone gives."""
    ext = extension(path)
    rust_test = (ext == "rs") & (_rust_path(path, "tests") | _rust_path(path, "benches"))
    return (
        F.when(contains_any(path, (".spec.", ".test.")) | (F.contains(path, F.lit("test")) & F.endswith(path, F.lit(".rs"))), "Test")
        .when(file_name(path).isin("Cargo.toml", "Cargo.lock"), "Config")
        .when(rust_test & ~contains_any(path, ("/bin/", "/examples/")), "Test")
        .when((ext == "ts") & F.contains(path, F.lit("component")), "Component")
        .when((ext == "ts") & F.contains(path, F.lit("service")), "Service")
        .when(ext.isin("scss", "css"), "Style")
        .when(ext.isin("json", "toml"), "Config")
        .otherwise("Other")
    )


def content_type(path: Column, content: Column) -> Column:
    """``path_type`` refined by the content; decorators outweigh a test file's name."""
    ext, name = extension(path), file_name(path)
    rust = (
        F.when(name == "lib.rs", "RustLibrary").when(name == "main.rs", "RustBinary").when(name == "mod.rs", "RustModule")
        .when(contains_any(content, ("#[cfg(test)]", "#[test]", "mod tests")), "RustTest")
        .when(contains_any(content, ("#[bench]", "test::Bencher")) | F.contains(path, F.lit("benches")), "RustBench")
        .when(F.contains(content, F.lit("fn main()")), "RustBinary").otherwise("RustModule")
    )
    script = (
        F.when(F.contains(content, F.lit("@Component")), "Component").when(F.contains(content, F.lit("@Injectable")), "Service")
        .when(contains_any(content, ("@Pipe", "implements PipeTransform")), "Pipe").when(F.contains(content, F.lit("@NgModule")), "Module").otherwise(path_type(path))
    )
    return F.when(ext == "rs", rust).when(name == "Cargo.toml", "Cargo").when(ext.isin("ts", "js"), script).otherwise(path_type(path))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def cyclomatic(content: Column) -> Column:
    """One more than the decisions."""
    return 1 + _sum([count_of(content, t) for t in DECISIONS])


def complexity(content: Column, n_lines: Column | None = None) -> Column:
    """``Low``, ``Medium`` or ``High`` by declarations, decisions and length."""
    n = line_count(content) if n_lines is None else n_lines
    score = _sum([count_of(content, t) for t in DECLARATIONS]) + cyclomatic(content) / 5.0
    return F.when((score > 15) | (n > 500), "High").when((score >= 3) | (n > 200), "Medium").otherwise("Low")


def weighted_complexity(content: Column, most: float = 10.0) -> Column:
    return F.least(F.lit(most), 1.0 + _sum([count_of(content, t) * F.lit(w) for t, w in WEIGHTED.items()]))


def context_complexity(content: Column) -> Column:
    """Complexity of a context: lines, branches, loops, awaits, tries and accesses, at least 0.1."""
    n = lambda t: count_of(content, t)
    return F.greatest(F.lit(0.1), line_count(content) * 0.02 + n("if ") * 0.3 + (n("for ") + n("while ")) * 0.4 + n("await ") * 0.2 + n("try ") * 0.3 + n(".") * 0.05)


def key_patterns(content: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(content, F.lit(w)), w) for w in PATTERN_WORDS]))


def usage_patterns(content: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(content, F.lit(w)), label) for w, label in USAGE.items()]))


def impact_scope(content: Column) -> Column:
    return F.when(contains_any(content, ("export", "public")), "Service").when(F.contains(content, F.lit("private")), "Local").when(F.contains(content, F.lit("async")) & F.contains(content, F.lit("await")), "Service").otherwise("Component")


def change_type(content: Column) -> Column:
    return F.when(contains_any(content, ("@Injectable", "service")), "ServiceModification").when(contains_any(content, ("@Component", "component")), "ComponentModification").when(contains_any(content, ("test", "spec")), "TestModification").otherwise("CodeModification")


def severity_level(score: Column) -> Column:
    return F.when(score <= 1, "Low").when(score <= 3, "Medium").when(score <= 5, "High").otherwise("Critical")


def content_severity(content: Column) -> Column:
    score = F.when(F.contains(content, F.lit("export")), 2).otherwise(0) + F.when(contains_any(content, ("async", "Promise")), 1).otherwise(0) + F.when(count_of(content, "function") > 5, 1).otherwise(0)
    return severity_level(score)


def module_type(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("app.module")), "Root").when(F.contains(path, F.lit("routing")), "Routing").when(contains_any(path, ("shared", "core")), "Shared").otherwise("Feature")


def provided_in(content: Column) -> Column:
    """The quoted value after ``providedIn:``, null without one."""
    return F.nullif(F.regexp_extract(content, r"providedIn:\s*['\"]([^'\"]*)['\"]", 1), F.lit(""))


def service_scope(content: Column) -> Column:
    p = provided_in(content)
    return F.when(p == "root", "Root").when(p == "platform", "Platform").otherwise("Module")


def layered_confidence(content: Column) -> Column:
    """``complexity`` 1, 5 or 10, ``dependencies`` and ``confidence`` of a first, cheap look at a content."""
    any_branch = contains_any(content, ("if", "for", "while"))
    c = F.when(any_branch & ((count_of(content, "if") > 3) | (count_of(content, "for") > 2)), 10).when(any_branch, 5).otherwise(1)
    d = count_of(content, "import") + count_of(content, "export")
    conf = F.when((c <= 5) & (d <= 10), 0.9).when((c <= 15) & (d <= 20), 0.6).otherwise(0.3)
    return F.struct(c.alias("complexity"), d.alias("dependencies"), conf.alias("confidence"))


#: What shows a section in a file of a type.
SECTIONS = {
    "Component": {"@Component": "Component decorator", "ngOnInit": "OnInit lifecycle", "ngOnDestroy": "OnDestroy lifecycle"},
    "Service": {"@Injectable": "Injectable service", "HttpClient": "HTTP client usage"},
    "Style": {"@media": "Media queries", "@mixin": "SCSS mixins"},
    "Pipe": {"@Pipe": "Pipe decorator", "PipeTransform": "PipeTransform interface", "pure: false": "Impure pipe", "standalone: true": "Standalone pipe"},
}


def relevant_sections(kind: Column, content: Column) -> Column:
    """The labels of the sections that a file of this type has."""
    out = F.array().cast("array<string>")
    for k, signs in reversed(SECTIONS.items()):
        out = F.when(kind == k, F.array_compact(F.array(*[F.when(F.contains(content, F.lit(s)), label) for s, label in signs.items()]))).otherwise(out)
    return out


def function_context(name: Column, path: Column, context: Column) -> Column:
    """What a function's surroundings tell: lines, complexity, scope, and what it depends on; null without a context."""
    from siftwork.functions.extract import dependencies

    facts = F.struct(name.alias("name"), path.alias("path"), F.lit(1).alias("line_start"), F.greatest(line_count(context), F.lit(1)).alias("line_end"), weighted_complexity(context).alias("complexity"), impact_scope(context).alias("scope"), dependencies(context).alias("dependencies"))
    return F.when(context.isNotNull(), facts)
