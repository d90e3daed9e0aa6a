"""Built-in rule tables and severity domains.

FIXED VALUES. Ids, names, patterns, thresholds, hours and messages below must
be exactly these for results to agree; they are data, stated as plain text.
"""

from __future__ import annotations

from typing import NamedTuple

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_WEIGHT = {"info": 0.1, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


class Rule(NamedTuple):
    rule_set: str
    rule_id: str
    name: str
    category: str
    severity: str
    languages: list
    patterns: list
    description: str
    suggestion: str = ""
    effort_hours: float = 0.0
    improvement: str = ""
    enabled: bool = True


def _security():
    s = "security"
    return [
        Rule(s, "SEC001", "SQL Injection Risk", "injection", "high", ["py"],
             [r'execute\s*\(\s*f["\'].*SELECT', r'execute\s*\(\s*f["\'].*INSERT', r'execute\s*\(\s*f["\'].*UPDATE',
              r'execute\s*\(\s*f["\'].*DELETE', r'execute\s*\(\s*["\'].*%s', r'execute\s*\(\s*["\'].*\+'],
             "Potential SQL injection: string formatting/concatenation in SQL queries",
             "Use parameterized queries instead of string formatting"),
        Rule(s, "SEC002", "Hardcoded Secret", "sensitive_data", "high", ["all"],
             [r'password\s*=\s*["\'][^"\']+["\']', r'secret\s*=\s*["\'][^"\']+["\']', r'api_key\s*=\s*["\'][^"\']+["\']',
              r'private_key\s*=\s*["\'][^"\']+["\']', r'token\s*=\s*["\'][^"\']{20,}["\']'],
             "Possible hardcoded password/secret in source code",
             "Use environment variables or secret management tools"),
        Rule(s, "SEC003", "Insecure Deserialization", "injection", "critical", ["py"],
             [r'pickle\.loads?\(', r'yaml\.load\(', r'marshal\.loads?\(', r'shelve\.open\('],
             "Use of pickle/yaml.load can lead to arbitrary code execution",
             "Use yaml.safe_load() or json for safe deserialization"),
        Rule(s, "SEC004", "Command Injection", "injection", "critical", ["py"],
             [r'subprocess\.\w+\(.*shell\s*=\s*True', r'os\.system\s*\(', r'os\.popen\s*\(', r'eval\s*\(', r'exec\s*\('],
             "Potential command injection via shell=True or unsanitized input",
             "Avoid shell=True; use subprocess with argument lists"),
        Rule(s, "SEC005", "Weak Cryptography", "crypto", "medium", ["py"],
             [r'hashlib\.md5\s*\(', r'hashlib\.sha1\s*\(', r'DES\.new\s*\(', r'ARC4\.new\s*\('],
             "Use of weak hash algorithms or encryption", "Use SHA-256+ for hashing, AES for encryption"),
        Rule(s, "SEC006", "Insecure HTTP", "misconfiguration", "medium", ["py"],
             [r'requests\.(get|post|put|delete|patch)\s*\(\s*["\']http://', r'urllib\.request\.urlopen\s*\(\s*["\']http://'],
             "HTTP connection without TLS", "Use HTTPS instead of HTTP for all external requests"),
        Rule(s, "SEC007", "Debug Mode Enabled", "misconfiguration", "medium", ["py"],
             [r'DEBUG\s*=\s*True', r'app\.debug\s*=\s*True', r'app\.run\s*\([^)]*debug\s*=\s*True'],
             "Debug mode should be disabled in production", "Set DEBUG=False in production environments"),
        Rule(s, "SEC008", "Error Information Disclosure", "error_handling", "low", ["py"],
             [r'traceback\.print_exc\s*\(\s*\)', r'raise\s+\w+.*\n.*return\s+str\(', r'return\s+str\(e\)'],
             "Stack trace or error details exposed to user", "Return generic error messages; log details server-side"),
        Rule(s, "SEC009", "Path Traversal Risk", "input_validation", "high", ["py"],
             [r'open\s*\(\s*[^)]*\+\s*', r'os\.path\.join\s*\([^)]*request', r'open\s*\(\s*request\.'],
             "File path may be user-controlled without validation", "Validate and sanitize all file paths; use allowlists"),
        Rule(s, "SEC010", "Insecure CORS", "misconfiguration", "medium", ["py", "js", "ts"],
             [r'CORS.*\*', r'Access-Control-Allow-Origin.*\*', r'allow_origins.*\*'],
             "CORS configured to allow all origins", "Restrict CORS to specific trusted domains"),
        Rule(s, "SEC011", "JavaScript eval Usage", "injection", "high", ["js", "ts"],
             [r'\beval\s*\(', r'new\s+Function\s*\('],
             "eval() can execute arbitrary code", "Avoid eval(); use JSON.parse() or other safe alternatives"),
        Rule(s, "SEC012", "XSS via innerHTML", "input_validation", "high", ["js", "ts"],
             [r'\.innerHTML\s*=', r'\.outerHTML\s*=', r'document\.write\s*\('],
             "innerHTML assignment may lead to XSS", "Use textContent or DOM API to prevent XSS"),
    ]


def _performance():
    p = "performance"
    return [
        Rule(p, "PERF001", "I/O Inside Loop", "io", "high", ["py"],
             [r'for\s+.*:\s*\n.*open\s*\(', r'for\s+.*:\s*\n.*\.read\s*\(', r'for\s+.*:\s*\n.*\.write\s*\(',
              r'for\s+.*:\s*\n.*requests\.', r'for\s+.*:\s*\n.*urllib'],
             "I/O operations inside loop can be batched", "Batch I/O operations outside loops", improvement="50-90%"),
        Rule(p, "PERF002", "Append in Loop", "algorithm", "low", ["py"], [r'\.append\s*\([^)]*\)\s*$'],
             "List comprehension is faster than append in loop", "Use list comprehension when possible", improvement="10-30%"),
        Rule(p, "PERF003", "String Concatenation in Loop", "algorithm", "medium", ["py", "js", "ts"], [r'\w+\s*\+=\s*["\']'],
             "String concatenation in loop is inefficient", "Use join() for multiple string concatenations", improvement="30-60%"),
        Rule(p, "PERF004", "Synchronous DB Query in Loop", "database", "critical", ["py"],
             [r'for\s+.*:\s*\n.*\.(execute|query|find|filter)\s*\(', r'while\s+.*:\s*\n.*\.(execute|query|find|filter)\s*\('],
             "Database query inside loop causes N+1 problem", "Use bulk queries or prefetch related data", improvement="80-99%"),
        Rule(p, "PERF005", "Global Lookup in Loop", "algorithm", "low", ["py"], [r'global\s+\w+'],
             "Global variable lookups are slower than local", "Cache global as local variable before loop", improvement="5-15%"),
        Rule(p, "PERF006", "Blocking Sleep", "concurrency", "medium", ["py"], [r'time\.sleep\s*\('],
             "Blocking sleep wastes thread time", "Use asyncio.sleep() in async code", improvement="20-50%"),
        Rule(p, "PERF007", "Large List Creation", "memory", "medium", ["py"],
             [r'range\s*\(\s*\d{5,}', r'\[.*for.*in\s+range\s*\(\s*\d{5,}'],
             "Creating large lists consumes memory", "Use generators instead of lists for large sequences",
             improvement="50-90% memory"),
        Rule(p, "PERF008", "Repeated Computation", "caching", "medium", ["py"],
             [r'@property\s*\n\s*def\s+\w+.*\n.*\n.*for\s+'],
             "Expensive property computed on every access", "Use @functools.cached_property or manual caching",
             improvement="50-99%"),
        Rule(p, "PERF009", "Synchronous Network Request", "network", "high", ["py"],
             [r'requests\.(get|post|put)\s*\([^)]*\)\s*$'],
             "Synchronous HTTP call blocks the thread", "Use aiohttp or httpx with async/await", improvement="50-80% latency"),
        Rule(p, "PERF010", "Nested Loop (O(n^2) Risk)", "algorithm", "high", ["py", "js", "ts", "go", "java"],
             [r'for\s+.*:\s*\n(\s+)for\s+'],
             "Nested loops may indicate O(n^2) complexity", "Consider using dict/set for O(1) lookups", improvement="50-99%"),
    ]


def _debt():
    d, todo = "debt", "TODO comment indicates unfinished work"
    return [
        Rule(d, "Unresolved TODO", "Unresolved TODO", "todo", "low", ["all"],
             [r'#\s*TODO', r'#\s*FIXME', r'#\s*HACK', r'#\s*XXX'], todo, effort_hours=2.0),
        Rule(d, "Unresolved TODO (JS/TS)", "Unresolved TODO (JS/TS)", "todo", "low", ["js", "ts", "java", "go"],
             [r'//\s*TODO', r'//\s*FIXME', r'//\s*HACK'], todo, effort_hours=2.0),
        Rule(d, "Commented Out Code", "Commented Out Code", "dead_code", "low", ["all"],
             [r'^\s*#\s*(def|class|import|from|if|for|while|return)\s'], "Commented-out code should be removed", effort_hours=0.5),
        Rule(d, "Long Function Hint", "Long Function Hint", "maintainability", "medium", ["all"],
             [r'^\s{16,}\w+'], "Too many nested blocks suggest long function", effort_hours=3.0),
        Rule(d, "Bare Except", "Bare Except", "error_handling", "high", ["all"],
             [r'except\s*:', r'except\s+Exception\s*:'], "Bare except catches all exceptions silently", effort_hours=1.0),
        Rule(d, "Pass in Except", "Pass in Except", "error_handling", "high", ["all"],
             [r'except\s+\w+.*:\s*\n\s+pass'], "Silently ignoring exceptions with pass", effort_hours=1.5),
        Rule(d, "Magic Number", "Magic Number", "readability", "low", ["all"],
             [r'(?<!["\w])\d{2,}(?!["\w])'], "Hardcoded numeric literal without explanation", effort_hours=0.25),
        Rule(d, "Many Function Parameters", "Many Function Parameters", "design", "medium", ["all"],
             [r'def\s+\w+\s*\([^)]{80,}\)'], "Function with many parameters is hard to maintain", effort_hours=2.0),
        Rule(d, "Hardcoded String Path", "Hardcoded String Path", "duplication", "medium", ["all"],
             [r'["\']/(?:usr|etc|var|tmp|home)/'], "Hardcoded file path should be configurable", effort_hours=1.0),
        Rule(d, "Deprecated API", "Deprecated API", "deprecation", "medium", ["all"],
             [r'\.warn\s*\(', r'deprecat', r'DeprecationWarning'], "Use of deprecated function or method", effort_hours=1.5),
    ]


SECURITY, PERFORMANCE, DEBT = _security(), _performance(), _debt()


class ThresholdRule(NamedTuple):
    rule_id: str
    name: str
    description: str
    category: str
    severity: str
    language: str
    enabled: bool
    threshold: int | None
    suggestion: str
    tags: list


_STRUCTURE = [
    # id, name, description, category, severity, language, threshold, suggestion, tags
    ("COMPLEX001", "Long Method", "函数过长，降低可读性和可维护性", "complexity", "medium", "all", 50,
     "将长函数拆分为更小的、职责单一的函数", ["complexity", "readability"]),
    ("COMPLEX002", "High Cyclomatic Complexity", "圈复杂度过高，逻辑分支太多", "complexity", "high", "all", 10,
     "简化条件逻辑，提取独立的方法或使用策略模式", ["complexity", "testing"]),
    ("COMPLEX003", "Deep Nesting", "代码嵌套层级过深", "complexity", "medium", "all", 4,
     "使用提前返回（guard clause）减少嵌套", ["complexity", "readability"]),
    ("COMPLEX004", "Large Class", "类过大，可能违反单一职责原则", "complexity", "medium", "all", 200,
     "将大类拆分为更小的、职责单一的类", ["complexity", "design"]),
    ("COMPLEX005", "Too Many Parameters", "函数参数过多", "complexity", "low", "all", 5,
     "使用参数对象或 builder 模式减少参数数量", ["complexity", "api-design"]),
    ("DESIGN001", "Deep Inheritance", "继承层级过深", "design", "high", "all", 3,
     "优先使用组合而非继承", ["design", "oop"]),
    ("DESIGN002", "Too Many Methods", "类方法过多", "design", "medium", "all", 15,
     "考虑拆分类或提取 mixin/trait", ["design", "oop"]),
    ("NAMING001", "Short Variable Name", "变量名过短（排除循环变量 i/j/k）", "naming", "low", "all", 2,
     "使用更有描述性的变量名", ["naming", "readability"]),
    ("PERF001", "Nested Loop", "嵌套循环可能导致 O(n^2) 或更高复杂度", "performance", "medium", "all", 2,
     "考虑使用哈希表、集合或其他数据结构优化查找", ["performance", "algorithm"]),
    ("MAINT001", "Magic Number", "代码中存在魔术数字", "maintainability", "low", "all", None,
     "将魔术数字提取为命名常量", ["maintainability", "readability"]),
    ("MAINT002", "Missing Docstring", "公共函数/类缺少文档字符串", "maintainability", "low", "python", None,
     "为公共 API 添加 docstring", ["maintainability", "documentation"]),
    ("SEC001", "Eval Usage", "使用 eval() 可能存在安全风险", "security", "critical", "python", None,
     "避免使用 eval()，使用 ast.literal_eval() 或其他安全替代", ["security", "python"]),
    ("SEC002", "Hardcoded Secret", "代码中可能包含硬编码的密钥或密码", "security", "critical", "all", None,
     "使用环境变量或配置文件管理敏感信息", ["security", "secrets"]),
]
STRUCTURE = [ThresholdRule(i, n, d, c, s, lang, True, t, sug, tags) for i, n, d, c, s, lang, t, sug, tags in _STRUCTURE]
STRUCTURE_SCHEMA = (
    "rule_id string, name string, description string, category string, severity string, language string, "
    "enabled boolean, threshold int, suggestion string, tags array<string>"
)

# Extension -> language, one map per use.
LANGUAGE_MAPS = {
    "analyzer": {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
                 ".go": "go", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".rs": "rust"},
    "dependency": {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java"},
    "display": {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".java": "Java", ".jsx": "JSX",
                ".tsx": "TSX", ".rs": "Rust", ".cpp": "C++", ".c": "C", ".rb": "Ruby", ".php": "PHP", ".html": "HTML",
                ".css": "CSS", ".sql": "SQL"},
    "multi": {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
              ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp",
              ".hpp": "cpp"},
}

# Per-language search patterns.
SYMBOL_PATTERNS = {
    "python": {"class": "class ", "function": "def ", "import": "import "},
    "javascript": {"class": "class ", "function": "function ", "import": "import "},
    "typescript": {"class": "class ", "function": "function ", "import": "import "},
    "java": {"class": "class ", "function": "public ", "import": "import "},
    "go": {"class": "type.*struct", "function": "func ", "import": "import "},
    "rust": {"class": "struct ", "function": "fn ", "import": "use "},
    "cpp": {"class": "class ", "function": r"(void|int|string|bool|float|double|char)\s+\w+\s*\(", "import": "#include "},
}

SOURCE_EXTENSIONS = [".py", ".js", ".ts", ".go", ".java", ".jsx", ".tsx", ".rs", ".cpp", ".c", ".rb", ".php"]
SKIPPED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".ruff_cache"]
EXCLUDED_DIRS = [".venv", "venv", "__pycache__", ".git", "node_modules", ".ruff_cache", ".mypy_cache", ".pytest_cache",
                 ".cache", "htmlcov", ".eggs"]
DIFF_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".cpp", ".cc", ".c", ".h", ".rs", ".rb", ".php"]
HOTSPOT_WORDS = ["if", "elif", "for", "while", "except", "with", "and", "or"]

BASE_IMAGES = {
    "nextjs": "node:20-alpine", "nextjs-bun": "oven/bun:1-alpine", "react": "node:20-alpine", "vue": "node:20-alpine",
    "angular": "node:20-alpine", "express": "node:20-alpine", "nuxt": "node:20-alpine", "node": "node:20-alpine",
    "static": "nginx:alpine", "fastapi": "python:3.12-slim", "python": "python:3.12-slim", "gin": "golang:1.22-alpine",
    "go": "golang:1.22-alpine", "rust": "rust:1.75-alpine", "java": "eclipse-temurin:21-jre-alpine",
}
DEFAULT_PORTS = {"nextjs": 3000, "react": 3000, "vue": 3000, "angular": 4200, "express": 3000, "nuxt": 3000, "node": 3000,
                 "static": 80, "fastapi": 8000, "python": 8000, "gin": 8080, "go": 8080, "rust": 8080, "java": 8080}
