"""Tables of constants: taxonomy, costs, patterns, rules, markers, models, tolerances, signals.

Fixed values: everything in this module is part of the formats and results that have to come out equal.
"""

from __future__ import annotations

from dataclasses import dataclass

FAILURE_CLASSES = ["code_change", "flaky_test", "infra_environment", "pipeline_config"]

SUBCATEGORIES = {
    "code_change": ["compile_error", "test_assertion", "type_check", "lint_or_format", "dependency_conflict", "policy_gate", "runtime_error"],
    "flaky_test": ["async_wait", "concurrency", "test_order_dependency", "randomness", "network_flakiness", "resource_leak"],
    "infra_environment": ["runner_outage", "dependency_registry", "network_timeout", "oom_or_disk", "external_service"],
    "pipeline_config": ["yaml_syntax", "action_version", "permissions_or_secrets", "cache_misconfig", "matrix_or_trigger", "build_step_misconfig"],
}

#: (truth, predicted) -> cost; equal classes cost nothing, all other pairs 1.
ERROR_COSTS = {("code_change", "flaky_test"): 3.0, ("code_change", "infra_environment"): 2.0, ("flaky_test", "code_change"): 1.5}


def error_cost(truth: str, predicted: str) -> float:
    return 0.0 if truth == predicted else ERROR_COSTS.get((truth, predicted), 1.0)


#: Log patterns by group, in the order of priority. Case-sensitive, searched in one line at a time.
PATTERN_GROUPS = [
    ("pytest", [r"^FAILED ", r"^ERROR ", r"^E\s+", r"=+ (FAILURES|ERRORS) =+", r"AssertionError"]),
    ("python_traceback", [r"Traceback \(most recent call last\)"]),
    ("compiler", [r"error(\[\w+\])?:", r": error ", r"SyntaxError", r"TypeError:"]),
    ("dependency", [r"Could not find a version", r"ResolutionImpossible", r"npm ERR!", r"ERESOLVE", r"404 Not Found", r"ETIMEDOUT"]),
    ("actions_runner", [r"##\[error\]", r"Process completed with exit code [1-9]"]),
    ("oom_disk", [r"OutOfMemoryError", r"(?<!\w)Killed(?!\w)", r"No space left on device", r"MemoryError"]),
    ("timeout_network", [r"The operation was canceled", r"timed out", r"Connection reset", r"TLS handshake (?:timeout|failure|error)"]),
]

CONTEXT_LINES = 20
TAIL_LINES = 200
MAX_CHARS = 24_000
MIN_CHARS = 200
TRUNCATED = "...[truncated]"

#: (class, subcategory, pattern): the first that is found anywhere in the log wins.
RULES = [
    ("infra_environment", "oom_or_disk", r"No space left on device"),
    ("infra_environment", "oom_or_disk", r"OutOfMemoryError|MemoryError|exit code 137"),
    ("infra_environment", "network_timeout", r"Could not resolve host|Connection reset|TLS handshake (?:timeout|failure|error)"),
    ("infra_environment", "runner_outage", r"The operation was canceled|The job running on runner .* has become unhealthy"),
    ("infra_environment", "dependency_registry", r"ERESOLVE|ResolutionImpossible|Could not find a version|npm ERR! 404"),
    ("pipeline_config", "permissions_or_secrets", r"Unable to resolve action|Input required and not supplied|Secret .* not found"),
    ("pipeline_config", "yaml_syntax", r"yaml: line \d+|Invalid workflow file|workflow is not valid"),
    ("flaky_test", "network_flakiness", r"Flaky|flaky test|Rerun|retrying"),
    ("code_change", "compile_error", r"error\[E\d+\]|SyntaxError|error TS\d+|: error:|cannot find symbol"),
    ("code_change", "type_check", r"mypy|type error|Incompatible types"),
    ("code_change", "lint_or_format", r"ruff|flake8|black|would reformat|lint"),
    ("code_change", "test_assertion", r"^FAILED |AssertionError|^E\s+assert"),
]
FALLBACK = ("code_change", "test_assertion")

SECRET_PATTERNS = [
    r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_-]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(api[_-]?key|secret|password|token)\s*[:=]\s*['\"][^'\"]{12,}['\"]",
]

SETUP_MARKERS = ["checkout", "set up ", "setup-", "install", "restore cache", "docker pull", "login"]

SIGNALS = ["rerun_passed", "cancelled_or_timed_out", "no_failed_step", "setup_step_failed", "test_step_failed"]

#: (metric, tolerance, higher is better), in the order of the report.
METRICS = [("coverage", 0.0, True), ("macro_f1", 0.30, True), ("accuracy", 0.20, True), ("cost_weighted_error", 0.40, False), ("hit_at_1", 0.35, True)]
SLACK = 1e-9
BASELINE_MODELS = ["baseline-regex", "baseline-majority"]

MAX_PATCH_FILES = 5
MAX_PATCH_LINES = 200
MIN_CONFIDENCE = 0.6


#: What bodies of refused requests say.
PER_MINUTE = ["perminute", "per minute", "requests per minute", "rpm"]
PER_DAY = ["perday", "per day", "requests per day", "daily limit"]
QUOTA_EXHAUSTED = ["exceeded your current quota", "quota_exceeded", "billing details"]

CONCLUSIONS = ["success", "failure", "cancelled", "timed_out", "skipped", "neutral", "action_required"]
SENSITIVE_KEYS = ["api_key", "apikey", "access_token", "auth_token", "authorization", "credential", "password", "secret"]

MAX_WAIT_SECONDS = 75.0
MAX_BACKOFF_SECONDS = 30.0
MAX_RATE_LIMIT_WAITS = 6
JITTER_FRACTION = 0.25
RETRYABLE_STATUSES = [429, 500, 502, 503, 504]
REDACTED = "[redacted]"
MAX_DIFF_CHARS = 8_000
MAX_FILE_CHARS = 12_000
MAX_SECTION_CHARS = 4_000
MAX_RANGE_LINES = 200
MAX_RANKED_FILES = 5
NO_DIFF = "no diff available"
NO_FILES = "none supplied"
NO_EVIDENCE = "none recorded"
NOT_FOUND = "not found"
DIRECT_OUTPUT_TOKENS = 2048
REASONING_OUTPUT_TOKENS = 16_384
LEVELS = ["NOTHING", "APPLIES", "LINTS", "FAILING_TEST_PASSES", "NOTHING_ELSE_BROKE"]
IMAGE_PREFIX = "bugswarm/cached-images:"
#: What a catalogue entry has to be.
QUALITY = {"lang": "Python", "reproducibility_status.status": "Reproducible", "stability": "5/5", "classification.code": "Yes", "classification.test": "No", "classification.build": "No", "metrics.num_of_changed_files": 1}

OUTPUT_TAIL_CHARS = 800
APPLY_OUTPUT_LINES = 20
PREVIEW_CHARS = 200


@dataclass(frozen=True)
class Model:
    name: str
    provider: str
    rpm: int | None
    rpd: int | None
    tpd: int | None
    reasoning: bool
    list_in: float
    list_out: float


#: None is no published cap.
MODELS = [
    Model("gemini-3.6-flash", "gemini", 10, 1000, None, False, 0.30, 2.50),
    Model("gemini-3.5-flash", "gemini", 10, 1000, None, False, 0.30, 2.50),
    Model("gemini-3.1-flash-lite", "gemini", 15, 1000, None, False, 0.10, 0.40),
    Model("groq-llama-3.3-70b", "groq", 30, 1000, 100_000, False, 0.59, 0.79),
    Model("openrouter-gpt-oss-20b", "openrouter", 20, 50, None, True, 0.03, 0.13),
    Model("openrouter-nemotron-120b", "openrouter", 20, 50, None, False, 0.10, 0.40),
    Model("openrouter-nemotron-9b", "openrouter", 20, 50, None, True, 0.04, 0.16),
    Model("openrouter-nemotron-550b", "openrouter", 20, 50, None, True, 0.60, 1.80),
    Model("ollama-llama3.1-8b", "ollama", None, None, None, False, 0.0, 0.0),
]
