import math

import pytest
from pyspark.sql import functions as F

from siftwork.functions import classify as C
from siftwork.functions import extract as X
from siftwork.functions import responses as R
from siftwork.functions import text as N
from siftwork.functions import vectors as V
from siftwork.functions.paths import lookup_key, normal_path, paths_match, project_relative


def one(spark, column, **values):
    names = list(values) or ["x"]
    schema = ", ".join(f"{n} {'string' if not isinstance(v, list) else 'array<double>'}" for n, v in values.items()) or "x string"
    given = tuple([float(x) for x in v] if isinstance(v, list) else v for v in map(values.get, names))
    return spark.createDataFrame([given or (None,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [("a//b", "./a/b"), (".\\a\\b", "./a/b"), ("./a/./b", "./a/b"), ("a/../b", "./b"), ("../a", "./../a"), ("", "."), (None, None)])
def test_normal_path(spark, given, want):
    assert one(spark, normal_path("p"), p=given) == want


@pytest.mark.parametrize(("given", "want"), [("", 0), ("single line", 1), ("line 1\n\nline 3", 3), ("a\n", 1), ("a\r\nb\r\n", 2), (None, None)])
def test_line_count(spark, given, want):
    assert one(spark, N.line_count(F.col("t")), t=given) == want
    if given is not None:
        assert one(spark, F.size(N.lines(F.col("t"))), t=given) == want


def test_text_measures(spark):
    assert one(spark, N.count_of(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, N.index_tokens(F.col("t")), t=" ab abc  déf\n") == ["abc", "déf"]
    assert one(spark, N.keywords(F.col("t")), t="The cat and dog at Home") == ["the", "cat", "dog", "home"]
    assert one(spark, N.preprocess(F.col("t")), t="  a\n\n// b\n/* c\n d ") == "a\nd"
    long = "\n".join(map(str, range(12)))
    assert one(spark, N.snippet(F.col("t")), t=long) == "0\n1\n2\n3\n4...\n10\n11"
    assert one(spark, N.context_lines(F.col("t"), F.lit(5), F.lit(5), 1), t=long) == "3\n4\n5"
    assert one(spark, N.token_estimate(F.col("t")), t="x" * 10) == 3


def test_jaccard(spark):
    a, b = N.words(F.col("a")), N.words(F.col("b"))
    assert one(spark, N.jaccard(a, b), a="hello world test", b="hello world example") == pytest.approx(0.5)
    assert one(spark, N.jaccard(a, b), a="x", b="y") == 0
    assert one(spark, N.jaccard(a, b), a="", b="") == 0


def test_vector_goldens(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 2, 3], b=[1.0, 2, 3]) == pytest.approx(1)
    assert one(spark, V.cosine(a, b), a=[1.0, 0], b=[0.0, 1]) == 0
    assert one(spark, V.cosine(a, b), a=[1.0, 0], b=[-1.0, 0]) == -1
    assert one(spark, V.cosine(a, b), a=[0.0, 0], b=[3.0, 4]) == 0
    assert one(spark, V.cosine(a, b), a=[1.0], b=[3.0, 4]) is None
    assert one(spark, V.cosine(a, b, strict=False), a=[1.0], b=[3.0, 4]) == 0
    assert one(spark, V.euclidean_distance(a, b), a=[0.0, 0], b=[3.0, 4]) == 5
    assert one(spark, V.manhattan_distance(a, b), a=[0.0, 0], b=[3.0, -4]) == 7
    assert one(spark, V.active_jaccard(a, b), a=[0.0, 0], b=[0.0, -1]) == 1
    assert one(spark, V.l2_normalize(a), a=[3.0, 4, 0]) == pytest.approx([0.6, 0.8, 0])
    assert one(spark, V.l2_normalize(a), a=[0.0, 0]) == [0, 0]
    assert one(spark, V.l1_normalize(a), a=[1.0, -3]) == [0.25, -0.75]
    assert one(spark, V.minmax_normalize(a), a=[1.0, 3, 2]) == [0, 1, 0.5]
    assert one(spark, V.minmax_normalize(a), a=[2.0, 2]) == [2, 2]
    assert one(spark, V.zscore_normalize(a), a=[1.0, 3]) == [-1, 1]
    q = one(spark, V.int8_quantize(a), a=[1.27, -0.5, 0.0])
    assert q["scale"] == pytest.approx(0.01) and list(q["codes"]) == [127, -50, 0]
    with pytest.raises(ValueError):
        V.register_metric("cosine", V.METRICS["dot"])


@pytest.mark.parametrize(("path", "want"), [("app.component.ts", "Component"), ("user.service.ts", "Service"), ("utils.ts", "Other"), ("styles.scss", "Style"), ("styles.css", "Style"), ("config.json", "Config"), ("app.spec.ts", "Test"), ("app.test.ts", "Test"), ("README.md", "Other"), ("tests/x.rs", "Test"), ("src/bin/a.rs", "Other")])
def test_path_type(spark, path, want):
    assert one(spark, C.path_type(F.col("p")), p=path) == want


def test_content_rules(spark):
    c = F.col("c")
    assert one(spark, C.content_type(F.col("p"), c), p="a.spec.ts", c="@Component({})") == "Component"
    assert one(spark, C.content_type(F.col("p"), c), p="a.rs", c="#[test]\nfn main() {}") == "RustTest"
    assert one(spark, C.cyclomatic(c), c="if a && b { for x in y {} }") == 4
    assert one(spark, C.complexity(c), c="fn a\n" * 16) == "High"
    assert one(spark, C.complexity(c), c="x") == "Low"
    assert one(spark, C.service_scope(c), c="@Injectable({ providedIn: 'root' })") == "Root"
    assert one(spark, C.content_severity(c), c="export async") == "Medium"
    r = one(spark, C.layered_confidence(c), c="x")
    assert (r["complexity"], r["confidence"]) == (1, 0.9)


def test_extraction(spark):
    c = F.col("c")
    code = "import { A, B } from './m';\nimport x from \"y\";\nexport class K {}\nexport const z = 1;\nconst u = await repo.find(1);"
    assert one(spark, X.imports(c), c=code) == ["./m", "y"]
    assert one(spark, X.imported_names(c), c=code) == ["A", "B"]
    assert one(spark, X.exports(c), c=code) == ["K", "z"]
    assert [(d["kind"], d["target"], d["strength"]) for d in one(spark, X.dependencies(c), c=code)] == [("Import", "A", 0.8), ("Import", "B", 0.8), ("FunctionCall", "repo", 0.6)]
    m = one(spark, X.module_info(c), c="@NgModule({ imports: [A, B], bootstrap: [C] })\nexport class M {}")
    assert (m["name"], m["imports"], m["is_root"]) == ("M", ["A", "B"], True)
    i = one(spark, X.component_info(c), c="@Component({ selector: 'app-x' })\nclass X {\n @Input() a: string;\n @Output() b = new E();\n ngOnInit() {} }")
    assert (i["selector"], i["inputs"], i["outputs"], i["hooks"]) == ("app-x", ["a"], ["b"], ["ngOnInit"])
    g = one(spark, X.guard_info(F.col("p"), c), p="a/auth.guard.ts", c="export const g: CanLoadFn = () => inject( Auth );")
    assert (g["name"], g["kind"], g["dependencies"]) == ("auth", "CanLoad", ["Auth"])
    s = one(spark, X.state_properties(c), c="private a = new BehaviorSubject<A>(x);\nreadonly b = signal(1);")
    assert [(p["name"], p["kind"], p["is_private"]) for p in s] == [("a", "BehaviorSubject", True), ("b", "Signal", False)]
    o = one(spark, X.observables(c), c="readonly a$ = this.a.asObservable();\nd: Observable<D> = this.get();\nlet e = 1;")
    assert [(p["name"], p["is_readonly"]) for p in o] == [("a$", True), ("d", False)]
    assert one(spark, X.style_variables(c), c="$a: 1;\n  $b : 2;") == ["$a", "$b"]
    assert one(spark, X.style_variables(c), c="a {}") is None
    assert one(spark, X.style_mixins(c), c="@mixin m($x) {}") == ["m"]
    p = one(spark, X.manifest_dependencies(c), c='{"dependencies": {"react": "1"}, "devDependencies": {"react": "2", "x": "3"}}')
    assert p == {"react": "1", "x": "3"}
    assert one(spark, X.framework(X.manifest_dependencies(c)), c='{"dependencies": {"react": "1"}}') == "React"
    for f in (X.imports, X.exports, X.dependencies, X.state_properties, X.observables):
        assert one(spark, f(c), c=None) is None
        assert list(one(spark, f(c), c="")) == []


@pytest.mark.parametrize(("text", "want"), [('{"confidence": 0.85}', 0.85), ('{"a": 1}', 0.8), ("no json", 0.7)])
def test_confidence(spark, text, want):
    assert one(spark, X.confidence(F.col("t")), t=text) == want


def test_json_part(spark):
    assert one(spark, X.json_part(F.col("t")), t='so: {"a": 1} end') == '{"a": 1}'
    assert one(spark, X.json_part(F.col("t")), t="so: {a} end") is None


def test_responses(spark):
    t = F.col("t")
    full = '{"semantic_relationships": [{"relationship_type": "extends", "source": "a", "target": "b", "strength": 0.9}, {"relationship_type": "odd", "source": "a", "target": "c"}, {"source": "x"}]}'
    r = one(spark, R.RELATIONSHIPS.rows(t), t=full)
    assert [(x["kind"], x["target"], x["strength"], x["description"]) for x in r] == [("Extends", "b", 0.9, "AI-detected relationship"), ("Uses", "c", 0.5, "AI-detected relationship")]
    assert one(spark, R.RELATIONSHIPS.rows(t), t="it depends")[0]["strength"] == 0.6
    assert one(spark, R.RELATIONSHIPS.rows(t), t="nothing") == []
    assert one(spark, R.RELATIONSHIPS.rows(t), t=None) is None
    risk = one(spark, R.RISK.rows(t), t='{"overall_risk": "critical", "security_implications": ["s"]}')[0]
    assert (risk["overall"], risk["breaking"], risk["security"], risk["mitigation"]) == ("Critical", 0.3, ["s"], ["Run comprehensive test suite"])
    assert one(spark, R.risk_from_text(t), t="a dangerous, slow change")["breaking"] == 0.5
    for kind, text in ((R.CHANGES, "workflow"), (R.IMPLICATIONS, "database"), (R.RECOMMENDATIONS, "add a test"), (R.CASCADES, "ripple")):
        assert len(one(spark, kind.rows(t), t=text)) >= 1
    rec = one(spark, R.RECOMMENDATIONS.rows(t), t='{"recommendations": [{"description": "d", "priority": "high"}]}')[0]
    assert (rec["priority"], rec["effort"], rec["steps"]) == ("High", "Medium", ["Review and implement"])
    assert one(spark, R.SUGGESTIONS.rows(t), t='{"suggestions": [{}]}')[0]["benefit"] == "Improved code quality"
    assert one(spark, R.DOMAINS.rows(t), t='{"affected_domains": ["a"]}')[0]["domains"] == ["a"]
    assert one(spark, R.SEMANTICS.rows(t), t='{"relevance": 0.1}')[0]["relevance"] == 0.1
    assert one(spark, R.named_functions(t), t='{"related_functions": ["a"]}') == ["a"]
    assert one(spark, R.named_functions(t), t="call foo() and barFunction now") == ["foo", "bar"]
    assert one(spark, R.embedding_of(t, 2), t='{"embedding": [1, 2]}') == [1, 2]
    assert one(spark, R.embedding_of(t, 3), t="[1, 2]") is None
    assert one(spark, R.bullet_names(t), t="- a: x\nno\n - b") == ["a", "b"]
    assert math.isclose(one(spark, N.sigmoid(F.lit(0.0)), t="x"), 0.5)


@pytest.mark.parametrize(("path", "relative", "key"), [("/p/app/src/a.ts", "./src/a.ts", "./src/a.ts"), ("/other/x/src/a.ts", "./src/a.ts", "./src/a.ts"), ("/etc/a", "/etc/a", "/etc/a"), ("src/app/test.ts", "src/app/test.ts", "./src/app/test.ts"), ("./a", "./a", "./a")])
def test_project_paths(spark, path, relative, key):
    assert one(spark, project_relative(F.col("p"), "/p/app"), p=path) == relative
    assert one(spark, lookup_key(F.col("p"), "/p/app"), p=path) == key


@pytest.mark.parametrize(("a", "b", "same"), [("./a", "a", True), ("./src/a", "/x/src/a", True), ("src/a", "src/b", False), ("a", "b", False)])
def test_paths_match(spark, a, b, same):
    assert one(spark, paths_match(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize(("value", "want"), [("'a'", "string"), ("-1.5e3", "number"), ("0xFF", "number"), ("true", "boolean"), ("null", "null"), ("[1]", "array"), ("{}", "object"), ("call()", "auto"), (None, None)])
def test_literal_type(spark, value, want):
    assert one(spark, N.literal_type(F.col("v")), v=value) == want


def test_ellipsis(spark):
    assert one(spark, N.ellipsis(F.col("t"), 6), t="abcdefgh") == "abc..."
    assert one(spark, N.ellipsis(F.col("t"), 6), t="abcdef") == "abcdef"
