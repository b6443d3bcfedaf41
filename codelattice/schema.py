"""Row layouts and closed vocabularies of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("parent_name", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("return_type", T.StringType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line", T.IntegerType()),
    ]
)

NODE_KEY = ["qualified_name"]
EDGE_KEY = ["kind", "source", "target", "file_path", "line"]

# They must equal the documented behaviour for results to match.

EDGE_WEIGHTS = {
    "CALLS": 1.0,
    "IMPORTS_FROM": 0.5,
    "INHERITS": 0.8,
    "IMPLEMENTS": 0.7,
    "CONTAINS": 0.3,
    "TESTED_BY": 0.4,
    "DEPENDS_ON": 0.6,
}

SECURITY_KEYWORDS = (
    "auth", "login", "password", "token", "session", "crypt", "secret",
    "credential", "permission", "sql", "query", "execute", "connect",
    "socket", "request", "http", "sanitize", "validate", "encrypt",
    "decrypt", "hash", "sign", "verify", "admin", "privilege",
)

RISK_INDEX_KEYWORDS = (
    "auth", "login", "password", "token", "session", "crypt",
    "secret", "credential", "permission", "sql", "execute",
)

ENTRY_NAME_PATTERNS = (
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_",
)

FRAMEWORK_DECORATOR_PATTERNS = (
    r"app\.(get|post|put|delete|patch|route|websocket)",
    r"router\.(get|post|put|delete|patch|route)",
    r"blueprint\.(route|before_request|after_request)",
    r"click\.(command|group)",
    r"celery\.(task|shared_task)",
    r"api_view",
    r"\baction\b",
    r"@(Get|Post|Put|Delete|Patch|RequestMapping)",
)

TEST_NAME_PATTERNS = (
    r"^test_", r"^Test", r"_test$", r"\.test\.", r"\.spec\.", r"_spec$",
)

TEST_FILE_PATTERNS = (
    r"test_.*\.py$", r".*_test\.py$", r".*\.test\.[jt]sx?$",
    r".*\.spec\.[jt]sx?$", r".*_test\.go$", r"tests?/", r".*_test\.dart$",
    r"test[_-].*\.[rR]$", r"tests/testthat/", r".*Test\.kt$", r".*Test\.java$",
)

TEST_RUNNER_NAMES = (
    "describe", "it", "test", "beforeEach", "afterEach", "beforeAll", "afterAll",
)

TEST_ANNOTATIONS = (
    "Test", "ParameterizedTest", "RepeatedTest", "TestFactory",
    "org.junit.Test", "org.junit.jupiter.api.Test",
)

EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".cs": "csharp", ".rb": "ruby", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".kt": "kotlin", ".swift": "swift", ".php": "php", ".scala": "scala",
    ".sol": "solidity", ".vue": "vue", ".dart": "dart", ".r": "r",
    ".mjs": "javascript", ".astro": "typescript", ".pl": "perl",
    ".pm": "perl", ".t": "perl", ".xs": "c", ".lua": "lua",
    ".ipynb": "notebook",
}

RULE_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".cs": "csharp", ".java": "java", ".go": "go", ".rb": "ruby",
    ".php": "php",
}

COMMON_NAME_WORDS = (
    "get", "set", "self", "init", "new", "create", "update", "delete",
    "add", "remove", "make", "build", "from", "to", "for", "with",
    "the", "and", "test", "main", "run", "do", "is", "has", "on",
    "of", "in", "at", "by", "my", "this", "that", "all", "none",
)

BUILTIN_CALL_NAMES = (
    "map", "filter", "reduce", "reduceRight", "forEach", "find", "findIndex",
    "some", "every", "includes", "indexOf", "lastIndexOf",
    "push", "pop", "shift", "unshift", "splice", "slice",
    "concat", "join", "flat", "flatMap", "sort", "reverse", "fill",
    "keys", "values", "entries", "from", "isArray", "of", "at",
    "trim", "trimStart", "trimEnd", "split", "replace", "replaceAll",
    "match", "matchAll", "search", "substring", "substr",
    "toLowerCase", "toUpperCase", "startsWith", "endsWith",
    "padStart", "padEnd", "repeat", "charAt", "charCodeAt",
    "assign", "freeze", "defineProperty", "getOwnPropertyNames",
    "hasOwnProperty", "create", "is", "fromEntries",
    "log", "warn", "error", "info", "debug", "trace", "dir", "table",
    "time", "timeEnd", "assert", "clear", "count",
    "then", "catch", "finally", "resolve", "reject", "all", "allSettled",
    "race", "any", "parse", "stringify",
    "floor", "ceil", "round", "random", "max", "min", "abs", "pow", "sqrt",
    "addEventListener", "removeEventListener", "querySelector",
    "querySelectorAll", "getElementById", "createElement", "appendChild",
    "removeChild", "setAttribute", "getAttribute", "preventDefault",
    "stopPropagation", "setTimeout", "clearTimeout", "setInterval",
    "clearInterval", "toString", "valueOf", "toJSON", "toISOString",
    "getTime", "getFullYear", "now", "isNaN", "parseInt", "parseFloat",
    "toFixed", "encodeURIComponent", "decodeURIComponent",
    "call", "apply", "bind", "next", "emit", "on", "off", "once",
    "pipe", "write", "read", "end", "close", "destroy",
    "send", "status", "json", "redirect", "set", "get", "delete", "has",
    "findUnique", "findFirst", "findMany", "createMany",
    "update", "updateMany", "deleteMany", "upsert",
    "aggregate", "groupBy", "transaction",
    "describe", "it", "test", "expect", "beforeEach", "afterEach",
    "beforeAll", "afterAll", "mock", "spyOn", "require", "fetch",
)

SEVERITY_ALIASES = {
    "CRITICAL": "CRITICAL", "ERROR": "HIGH", "HIGH": "HIGH",
    "WARNING": "MEDIUM", "MEDIUM": "MEDIUM", "INFO": "LOW", "LOW": "LOW",
}

DEDUP_SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
REPORT_SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}

IMPACT_MAX_DEPTH = 2
FLOW_MAX_DEPTH = 15
SEARCH_LIMIT = 20
RRF_K = 60

SQL_TABLE_PATTERN = (
    r"(?i)(?:FROM|JOIN|INTO|CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)|INSERT\s+OVERWRITE)"
    r"\s+((?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*)"
)
