"""Fixed values that results depend on: suffixes, word lists, patterns, thresholds. They are data, not logic."""

from __future__ import annotations

# File suffix -> language.
LANGUAGE_OF_SUFFIX = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go",
    ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".rb": "ruby", ".rake": "ruby", ".php": "php", ".php3": "php", ".php4": "php",
    ".php5": "php", ".phtml": "php",
}

# Directories that are skipped.
SKIP_DIRS = ["vendor", "node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "env", ".tox", "coverage", ".nyc_output", "target", "out", "bin", "obj", ".idea", ".vscode"]

# Path patterns that are skipped.
SKIP_PATTERNS = [
    r"/migrations/\d+_.*\.py$", r"(?:^|/)alembic/versions/.*\.py$", r"_pb2\.py$", r"\.pb\.go$", r"\.pb\.ts$", r"\.min\.js$", r"\.min\.css$", r"\.generated\.[a-z]+$", r"\.auto\.[a-z]+$",
    r"package-lock\.json$", r"yarn\.lock$", r"Gemfile\.lock$", r"Cargo\.lock$", r"(?:^|/)tests?\.py$", r"(?:^|/)test_[^/]+\.py$", r"(?:^|/)[^/]+_tests?\.py$", r"(?:^|/)tests?/",
    r"(?:^|/)__tests__/", r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$",
]
MINIFIED_LINE = 500

# Words that carry no meaning in names and bodies.
STOP_WORDS = [
    "self", "true", "false", "none", "null", "undefined", "async", "await", "return", "yield", "raise", "pass", "with", "import", "from", "class", "function", "const", "let", "var", "elif",
    "else", "super", "this", "catch", "throw", "void", "export", "default", "static", "public", "private", "protected", "type", "string", "number", "boolean", "apps", "backend", "frontend",
    "views", "models", "tasks", "utils", "request", "response", "result", "error", "value", "item", "name", "args", "kwargs", "params", "config", "logger", "logging", "data", "repo",
    "repository", "github", "user", "branch", "commit", "file", "path", "code", "chunk", "chunks", "object", "list", "dict", "array", "process", "handle", "execute", "perform", "cluster",
    "blame", "debt", "webhook", "finding", "violation", "ingest", "ingestion", "parse", "parsing", "score", "scores", "velocity", "heatmap", "pipeline",
]

# Naming conventions and the names that are exempt.
NAMING = {"snake_case": r"^_?[a-z][a-z0-9_]*$", "camelCase": r"^[a-z][a-zA-Z0-9]*$", "PascalCase": r"^[A-Z][a-zA-Z0-9]*$", "SCREAMING_SNAKE_CASE": r"^[A-Z][A-Z0-9_]*$"}
EXEMPT_NAMES = [
    "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpTestData", "main", "run",
]

# What an import line names, by language.
IMPORTS = {
    "python": r"^\s*(?:import|from)\s+([\w.]+)", "javascript": r"""^\s*(?:import\s|require\s*\()\s*['"]([^'"]+)['"]""", "typescript": r"""^\s*(?:import\s|require\s*\()\s*['"]([^'"]+)['"]""",
    "tsx": r"""^\s*(?:import\s|require\s*\()\s*['"]([^'"]+)['"]""", "java": r"^\s*import\s+([\w.]+)", "go": r'^\s*"([^"]+)"', "rust": r"^\s*use\s+([\w:]+)",
    "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "php": r"""^\s*(?:use|require|include)(?:_once)?\s+['"]?([^\s;'"(]+)""", "c": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    "cpp": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
}

# Branching words, by language.
BRANCHES = {
    "python": r"\b(if|elif|for|while|except|and|or|with)\b", "javascript": r"\b(if|else if|for|while|catch|&&|\|\||\?)\b", "typescript": r"\b(if|else if|for|while|catch|&&|\|\||\?)\b",
    "tsx": r"\b(if|else if|for|while|catch|&&|\|\||\?)\b", "java": r"\b(if|else if|for|while|catch|case|&&|\|\||\?)\b", "go": r"\b(if|else if|for|select|case|&&|\|\|)\b",
    "rust": r"\b(if|else if|for|while|match|&&|\|\||\?)\b", "c": r"\b(if|else if|for|while|switch|case|&&|\|\||\?)\b", "cpp": r"\b(if|else if|for|while|switch|case|catch|&&|\|\||\?)\b",
    "ruby": r"\b(if|elsif|unless|while|until|rescue|&&|\|\|)\b", "php": r"\b(if|elseif|for|foreach|while|catch|case|&&|\|\||\?)\b",
}
OTHER_BRANCHES = r"\b(if|for|while)\b"

# Weights and thresholds.
DEBT_WEIGHTS = {"complexity": 0.3, "duplication": 0.3, "violations": 0.2, "cluster_membership": 0.2}
SEVERITY_WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 0}
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CLUSTER_DISTANCE, MATCH_DISTANCE, MIN_SAMPLES, FLAG_GROWTH, SPREADING_GROWTH = 0.15, 0.02, 3, 0.20, 0.10
MIN_LINES, MIN_COMPLEXITY, MAX_LINE_RATIO, MIN_BODY_OVERLAP = 20, 3, 2.5, 0.15

# Explicit secrets, in order.
SECRETS = [
    (r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"']{6,}["']""", "Hardcoded password"), (r"""(?i)(api_key|apikey|api[-_]key)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded API key"),
    (r"""(?i)(secret_key|secretkey|secret)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded secret key"), (r"""(?i)(auth_token|access_token|refresh_token)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded token"),
    (r"""(?i)(private_key|privatekey)\s*[:=]\s*["'][^"']{8,}["']""", "Hardcoded private key"), (r"AKIA[0-9A-Z]{16}", "AWS Access Key ID"),
    (r"""(?i)aws_secret_access_key\s*[:=]\s*["'][A-Za-z0-9/+=]{40}["']""", "AWS Secret Access Key"), (r"ghp_[a-zA-Z0-9]{36}", "GitHub Personal Access Token"), (r"gho_[a-zA-Z0-9]{36}", "GitHub OAuth Token"),
    (r"sk-[a-zA-Z0-9]{48}", "OpenAI API Key"), (r"""(?i)(database_url|db_url)\s*[:=]\s*["'][^"']*:[^"']+@[^"']+["']""", "Database URL with credentials"),
]
PLACEHOLDER = r"(?i)(example|placeholder|test|fake|dummy|todo|fixme|change[-_]?me|replace|your[-_]|<[A-Z_]+>|\$\{|\$[A-Z_]+)"
HEX_STRING = r"""["']([A-Fa-f0-9]{32,64})["']"""

# Concatenated SQL, by language, in order.
SQL_INJECTION = {
    "python": [
        r"""(?i)(execute|executemany)\s*\(\s*[f"'](SELECT|INSERT|UPDATE|DELETE|DROP)[^)]*\+""", r"""(?i)(execute|executemany)\s*\(\s*"[^"]*"\s*%\s*\(""", r"""(?i)\b(sql|query)\s*=\s*f["'].*?\{[^}]+\}""",
        r"""(?i)(execute|executemany)\s*\(\s*f["'][^)]*\{[^}]+\}""", r"""(?i)["'].*?(SELECT|INSERT|UPDATE|DELETE|DROP).*["']\.format\s*\(""", r"""(?i)(sql|query)\s*\+=\s*["']""",
        r"""(?i)["'].*(SELECT|INSERT|UPDATE|DELETE|DROP).*["']\s*\+\s*\w""",
    ],
    "java": [r"""(?i)(execute|executeQuery|executeUpdate)\s*\(\s*"[^"]*"\s*\+""", r"(?i)(execute|executeQuery|executeUpdate)\s*\(\s*new\s+StringBuilder", r"""(?i)String\s+\w*(sql|query|SQL|Query)\s*=\s*"[^"]*"\s*\+"""],
    "php": [r"""(?i)(mysql_query|mysqli_query|query)\s*\(\s*["'].*["']\s*\.\s*\$""", r"(?i)(mysql_query|mysqli_query|query)\s*\([^)]*\$_(GET|POST|REQUEST)", r"""(?i)\$sql\s*=\s*["'].*["']\s*\.\s*\$"""],
    "ruby": [r"""(?i)(execute|find_by_sql)\s*\(\s*["'].*["']\s*\+""", r"""(?i)(execute|find_by_sql)\s*\(\s*"[^"]*#\{""", r"""(?i)where\s*\(\s*"[^"]*#\{""", r"""(?i)where\s*\(\s*"[^"]*"\s*\+"""],
    "go": [r"(?i)(Query|Exec|QueryRow)\s*\(\s*fmt\.(Sprintf|Sprint)\s*\(", r"""(?i)(Query|Exec|QueryRow)\s*\(\s*"[^"]*"\s*\+"""],
}

# Dangerous calls, by language, in order: pattern, title, severity.
_EVAL = (r"\beval\s*\(", "Use of eval()", "critical")
_FUNCTION = (r"\bnew\s+Function\s*\(", "Use of new Function()", "high")
_HTML = [(r"\.innerHTML\s*=([^=]|$)", "Direct innerHTML assignment", "medium"), (r"\.outerHTML\s*=([^=]|$)", "Direct outerHTML assignment", "medium")]
DANGEROUS = {
    "python": [
        _EVAL, (r"\bexec\s*\(", "Use of exec()", "high"), (r"\bpickle\s*\.\s*loads?\s*\(", "Insecure deserialization via pickle", "high"),
        (r"\byaml\s*\.\s*load\s*\((?!.*Loader\s*=\s*yaml\.SafeLoader)(?!.*Loader\s*=\s*yaml\.FullLoader)", "yaml.load() without SafeLoader", "high"), (r"\bmarshal\s*\.\s*loads?\s*\(", "Use of marshal.loads()", "high"),
        (r"\bos\s*\.\s*system\s*\(", "Use of os.system()", "medium"), (r"\bsubprocess\s*\.\s*(call|run|Popen)\s*\([^)]*shell\s*=\s*True", "subprocess with shell=True", "high"), (r"\b__import__\s*\(", "Dynamic __import__() call", "medium"),
    ],
    "javascript": [_EVAL, _FUNCTION, (r"\bdocument\.write\s*\(", "Use of document.write()", "medium"), *_HTML],
    "typescript": [_EVAL, _FUNCTION, *_HTML],
    "tsx": [_EVAL, (r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML usage", "medium")],
    "php": [
        _EVAL, (r"""\bassert\s*\(\s*["']""", "assert() with string argument", "high"), (r"\b(exec|system|shell_exec|passthru|popen)\s*\(", "Dangerous system call", "high"), (r"\bunserialize\s*\(", "Insecure unserialize()", "high"),
        (r"\bpreg_replace\s*\([^,]*\/e", "preg_replace with /e modifier (code execution)", "critical"),
    ],
    "ruby": [
        _EVAL, (r"\binstance_eval\s*\(", "Use of instance_eval()", "high"), (r"\bclass_eval\s*\(", "Use of class_eval()", "high"), (r"\bmodule_eval\s*\(", "Use of module_eval()", "high"),
        (r"\bsystem\s*\(", "Use of system()", "medium"), (r"\bMarshal\.load\s*\(", "Insecure Marshal.load()", "high"),
    ],
    "java": [
        (r"Runtime\.getRuntime\(\)\.exec\(", "Runtime.exec() — command injection risk", "high"), (r"\bnew\s+ProcessBuilder\s*\(", "ProcessBuilder — verify input sanitization", "medium"),
        (r"\bObjectInputStream\b", "ObjectInputStream — insecure Java deserialization", "high"), (r"\.forName\s*\(", "Class.forName() dynamic class loading", "medium"),
    ],
    "go": [(r"\bexec\.Command\s*\(", "exec.Command() — verify input is not user-controlled", "medium")],
    "c": [
        (r"\bgets\s*\(", "Use of gets() — unsafe, use fgets() instead", "critical"), (r"\bsprintf\s*\(", "sprintf() — prefer snprintf() with explicit size", "medium"), (r"\bstrcpy\s*\(", "strcpy() — prefer strncpy() or strlcpy()", "medium"),
        (r"\bstrcat\s*\(", "strcat() — prefer strncat()", "medium"), (r"\bsystem\s*\(", "system() — command injection risk", "high"),
    ],
    "cpp": [(r"\bgets\s*\(", "Use of gets() — unsafe, use fgets() instead", "critical"), (r"\bsystem\s*\(", "system() — command injection risk", "high"), (r"\bsprintf\s*\(", "sprintf() — prefer snprintf()", "medium")],
    "rust": [],
}

# Insecure random numbers and open redirects, by language, in order.
INSECURE_RANDOM = {
    "python": [r"\brandom\s*\.\s*(random|randint|randrange|choice|choices|shuffle|uniform|sample)\s*\("], "javascript": [r"\bMath\.random\s*\("], "typescript": [r"\bMath\.random\s*\("], "tsx": [r"\bMath\.random\s*\("],
    "java": [r"\bnew\s+Random\s*\(\)"], "php": [r"\b(rand|mt_rand|array_rand)\s*\("], "ruby": [r"\bRandom\s*\.\s*rand\s*\(", r"\brand\s*\("],
}
OPEN_REDIRECT = {
    "python": [r"redirect\s*\(\s*request\.(GET|POST|args|query_params)[\[.]", r"redirect\s*\(\s*request\.(GET|POST|args|query_params)\.get\s*\(", r"HttpResponseRedirect\s*\(\s*request\.(GET|POST)", r"return\s+redirect\s*\(\s*request\.args"],
    "php": [r"""header\s*\(\s*["']Location:.*\$_(GET|POST|REQUEST|SERVER)""", r"""header\s*\(\s*["']Location:\s*["']\s*\.\s*\$_(GET|POST|REQUEST)"""],
    "javascript": [r"res\.redirect\s*\(\s*req\.(query|params|body)", r"window\.location(?:\.href)?\s*=\s*(?:location\.search|new URLSearchParams|req\.|request\.)"],
    "typescript": [r"res\.redirect\s*\(\s*req\.(query|params|body)"], "ruby": [r"redirect_to\s+params\[", r"redirect_to\s+request\.(params|query_parameters|GET)"],
}

# Decorators that make a route, and those that ask for authentication.
ROUTE_DECORATORS = ["route", "get", "post", "put", "patch", "delete", "head", "api_view", "action"]
AUTH_DECORATORS = [
    "login_required", "auth_required", "jwt_required", "requires_auth", "permission_required", "token_required", "authenticate", "protected", "require_http_methods",
    "staff_member_required", "user_passes_test", "authentication_required",
]
