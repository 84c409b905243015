"""Catalogs, word lists and patterns that decide results.

Everything here is data. All rule and security patterns ignore case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    reason: str | None = None


# Default security patterns, in match order.
SECURITY_PATTERNS = [
    Pattern("JWT Token", r"eyJ[0-9a-zA-Z\-_.]+"),
    Pattern("Authorization Header", r"Authorization: Bearer [a-zA-Z0-9\-_.]+"),
    Pattern("API Key", r"API[_-]?KEY[:=\s][a-zA-Z0-9\-_.]+"),
]

# Default rules, in match order.
RULE_PATTERNS = [
    Pattern("Database Error", r"(?:database|db).*error", "Database operation failed."),
    Pattern("Service Timeout", r"(?:timeout|timed out|request timed out)", "Service call timed out."),
    Pattern("HTTP 500 Error", r"status\s*[:=]\s*500", "HTTP 500 server error."),
    Pattern("Process Crash", r"(?:process|service)\s*(?:exited|crashed|terminated)", "Process crash detected."),
    Pattern("Restart Detected", r"(?:restart|restarting)", "Process or pod restart detected."),
    Pattern("Dependency Failure", r"(?:dependency|service)\s*(?:unavailable|failed|error)", "Dependency failure detected."),
    Pattern("Configuration Issue", r"(?:invalid|missing)\s*configuration", "Configuration issue."),
    Pattern("Resource Limit Issue", r"(?:out of memory|OOM|cpu limit exceeded|quota exceeded)", "Resource limit breach."),
]

# Additional catalogs of the sample configuration.
SAMPLE_SECURITY_PATTERNS = [
    Pattern("Slack Token", r"xox[baprs]-[0-9a-zA-Z]+"),
    Pattern("Basic Auth Header", r"Authorization: Basic [a-zA-Z0-9=]+"),
]
SAMPLE_RULE_PATTERNS = [
    Pattern("Kubernetes CrashLoop", r"Back-off restarting failed container", "Kubernetes pod CrashLoop detected."),
    Pattern("Invalid User", r"Invalid user .* from .*", "Possible brute-force SSH login attempt."),
    Pattern("Payment Failure", r"payment.*failed", "Payment operation failed"),
    Pattern("Disk Full", r"no space left on device", "Disk capacity exceeded"),
]

# Behaviour rules of the sample configuration.
SAMPLE_BEHAVIOR_RULES = [
    {"name": "Repeated Failed Logins", "type": "count", "group_by": "user", "window_minutes": 5, "threshold": 1,
     "pattern": "Failed login attempt.*password|Failed login attempt.*user not found", "reason": "Repeated failed login attempts."},
    {"name": "Cross-Organization API Usage", "type": "distinct_count", "group_by": "user", "field": "organization_id", "window_minutes": 60, "threshold": 2,
     "pattern": "GET /api/search|POST /api/search", "reason": "Same user accessed multiple organization IDs within an hour."},
    {"name": "Excessive Exports", "type": "count", "group_by": "user", "window_minutes": 60, "threshold": 5,
     "pattern": "export", "reason": "Multiple export actions detected by the same user within an hour."},
    {"name": "Password Reset Flood", "type": "count", "group_by": "user", "window_minutes": 1440, "threshold": 2,
     "pattern": "password reset|forgot password", "reason": "Multiple password reset requests within a day."},
    {"name": "HTTP 4xx/5xx Spike", "type": "ratio", "group_by": "application", "window_minutes": 10, "threshold_ratio": 0.4,
     "pattern": r'HTTP/1(?:\.\d)?"\s*(?:4\d\d|5\d\d)', "reason": "Spike in failed HTTP responses for this application."},
    {"name": "API Rate Limit Exceeded", "type": "count", "group_by": "ip", "window_minutes": 10, "threshold": 1,
     "pattern": "Rate limit exceeded for IP|Rate limit exceeded for user", "reason": "User or IP hit API rate limit."},
]

# Words that make a verdict security related.
SECURITY_KEYWORDS = [
    "security", "breach", "unauthorized", "authentication", "auth", "login", "password",
    "token", "credential", "privilege", "permission", "access", "intrusion", "attack",
    "malicious", "suspicious", "threat", "vulnerability", "exploit", "injection",
    "xss", "csrf", "sql injection", "brute force", "ddos", "dos", "phishing",
    "malware", "virus", "trojan", "ransomware", "backdoor", "rootkit", "keylogger",
    "firewall", "blocked", "denied", "forbidden", "failed login", "invalid user",
    "certificate", "ssl", "tls", "encryption", "decrypt", "hash", "signature",
    "audit", "compliance", "policy violation", "data leak", "exposure",
]

# Log patterns that make a row security related.
SECURITY_LOG_PATTERNS = [
    r"failed.*login", r"invalid.*user", r"authentication.*failed", r"access.*denied",
    r"permission.*denied", r"unauthorized.*access", r"security.*violation",
    r"blocked.*request", r"suspicious.*activity", r"malicious.*request",
    r"sql.*injection", r"xss.*attack", r"csrf.*token", r"brute.*force",
    r"ddos.*attack", r"firewall.*block", r"intrusion.*detect", r"virus.*detect",
    r"malware.*detect", r"certificate.*error", r"ssl.*error", r"encryption.*failed",
    r"audit.*failure", r"compliance.*violation", r"data.*breach", r"information.*leak",
    r"privilege.*escalation", r"buffer.*overflow", r"code.*injection",
    r"path.*traversal", r"directory.*traversal",
]

# What counts as a secret in a line (our own scanner catalog).
SECRET_PATTERNS = [
    r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9/+_.\-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?:bearer|basic)\s+[A-Za-z0-9._~+/=\-]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"\b[0-9a-fA-F]{40,}\b",
]

# Words showing an error in a line, in report order.
ERROR_WORDS = [
    "error", "exception", "fail", "invalid", "unable to", "cannot", "timeout", "refused",
    "denied", "rejected", "unauthorized", "crash", "fatal", "critical", "unexpected",
    "undefined", "null", "missing", "not found", "unavailable",
]
# Startup words.
STARTUP_WORDS = [
    "start", "init", "boot", "launch", "starting", "initializing", "booting",
    "launching", "loading", "configuring", "configuration", "setup",
]
# Sensitive patterns.
SENSITIVE_PATTERNS = [
    r"password", r"secret", r"token", r"key", r"credential", r"auth", r"login", r"user",
    r"account", r"api[-_]?key", r"[a-zA-Z0-9+/]{40,}", r"[0-9a-f]{32,}",
]
# Action words.
ACTION_WORDS = ["started", "stopped", "created", "deleted", "updated", "failed", "connected", "disconnected"]
# Error type patterns.
ERROR_TYPE_PATTERNS = [
    ("timeout", r"\b(?:timeout|timed?\s*out)\b"),
    ("connection", r"\b(?:connection|connect)\s*(?:error|fail|refused)\b"),
    ("permission", r"\b(?:permission|access)\s*(?:denied|error)\b"),
    ("validation", r"\b(?:invalid|validation)\s*(?:error|fail)\b"),
    ("resource", r"\b(?:memory|disk|cpu|resource)\s*(?:error|exhausted|full)\b"),
]
# Token patterns.
TOKEN_PATTERNS = [
    ("ip_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("hash", r"[a-fA-F0-9]{32}"),
    ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("http_request", r"(?:GET|POST|PUT|DELETE|PATCH)\s+/\S+"),
]

# What the masking of a line replaces, in order, ignoring case where marked.
WORD = r"\p{L}\p{N}_"
REDACTIONS = [
    (rf"(?i)(Bearer|Token|Authorization)\s+[{WORD}\-.]+", "$1 <REDACTED>"),
    (r"eyJ[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+", "<JWT_TOKEN>"),
    (r"(?i)(API[_-]?KEY[:=\s])[a-zA-Z0-9\-_]+", "$1<REDACTED>"),
]
# What the cleaning of a line replaces, in order.
CLEANINGS = [
    (r"\[.*?\]", ""),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}.*?Z", ""),
    (r"[a-f0-9\-]{32,}", "<ID>"),
    (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "<IP>"),
    (r"(?i)(?:Bearer|Token|APIKey|Secret)\s+\S+", "<SECRET>"),
    (r"\s+", " "),
]
# How a line names its level, component and action.
NAME = "[A-Za-z0-9._-]+"
LEVELS = "(ERROR|WARN|INFO|DEBUG|TRACE|FATAL)"
LEVEL_MARKS = [rf"\[{LEVELS}\]", f"{LEVELS}:", f"{LEVELS} -"]
SEVERITY_WORDS = [("ERROR", "(?i)error|exception|fail|crash|fatal"), ("WARN", "(?i)warn|caution|attention")]
COMPONENT_PATTERNS = [rf"\[({NAME})\]", rf"({NAME})\s*:", rf"({NAME})\.(?:connect|init|start|config|process)"]
COMPONENT_AFTER_LEVEL = rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|\[(?:INFO|DEBUG|ERROR|WARN)\])[:\s]+({NAME})"
ACTION_VERBS = ("initializing|starting|configuring|processing|connecting|loading|saving|updating|"
                "creating|deleting|sending|receiving")
ACTION_STEMS = "init|start|stop|config|process|connect|disconnect|load|save|update|create|delete|send|receive"
ACTION_MARKS = [rf":\s*({NAME})", rf"\.\s*({NAME})\s*:"]
OPERATIONS = [("retry_operation", "(?i)retry|retrying|attempt"), ("connection_operation", "(?i)connect|connection"),
              ("configuration_operation", "(?i)config|configuration")]
LEVEL_WORDS = [("error", r"\b(?:error|fail|exception|critical)\b"), ("warning", r"\b(?:warn|warning)\b"),
               ("info", r"\b(?:info|notice)\b"), ("debug", r"\b(?:debug|trace)\b")]
LEADING = r"^\[?([a-zA-Z0-9_.-]+)\]?[:|\s]"

# Result texts.
SECRET_REASON = "Contains possible secret/token."
EMPTY_REPLY_REASON = "Empty reply from LLM"
REPLY_ERROR = "LLM Error: "
STACK_FRAME_REASON = "Stack trace line, follows an actual error."
FLOOD_MARK = "[LOG FLOOD] "
FLOOD_TEXT = " occurrences of similar logs: "
THREATS = {"flood": "LOG_FLOODING", "leaks": "DATA_EXPOSURE", "rules": "RULE_VIOLATIONS", "errors": "HIGH_ERROR_RATE"}

# Display labels of the verdict classes.
LABELS = {
    "Sensitive Information Leak": "🔑 Sensitive Leak",
    "Possible Security Threat": "🚨 Security Threat",
    "Operational Error": "⚙️ Operational Error",
    "Routine": "✅ Routine",
    "Unknown": "❓ Unknown",
    "Error": "❗️ LLM Error",
}

# Tags a verdict may carry.
VALID_TAGS = [
    "Error", "Warning", "Info", "Debug", "Database", "Network", "Security", "Performance",
    "Configuration", "System", "Application", "API", "Authentication", "Authorization",
    "Validation", "Memory", "CPU", "Disk", "Cache", "Queue", "Timeout", "Retry", "Recovery",
    "Startup", "Shutdown", "Dependency", "Integration", "Migration", "Deployment", "Unknown",
]

# Timestamp fields.
# Literals in lower case: a text in which a pattern finds something holds one of its literals. A pattern not named here is tried on every text.
HEADS = dict(zip((*(p.pattern for p in (*SECURITY_PATTERNS, *SAMPLE_SECURITY_PATTERNS)), *SECRET_PATTERNS), (
    ("eyj",), ("authorization: bearer ",), ("key",), ("xox",), ("authorization: basic ",),
    ("key", "secret", "token", "passw", "pwd"), ("private key-----",), ("bearer", "basic"), ("akia",), ("eyj",))))
# A text in which a redaction, a security or a secret pattern finds something holds one of these literals, or so many hexadecimal digits.
SUSPECT = ("key", "authorization", "akia", "basic", "bearer", "eyj", "passw", "pwd", "secret", "token", "xox")
SUSPECT_RUN = "[0-9a-fA-F]{40}"
TIMESTAMP_FIELDS = ["@timestamp", "timestamp", "time", "@time", "datetime", "date"]
# Log extensions.
LOG_EXTENSIONS = ("json", "log", "txt")


def merge_catalogs(*catalogs: list[Pattern]) -> list[Pattern]:
    """One catalog from several, order kept (the earlier entry wins a match)."""
    return [p for catalog in catalogs for p in catalog]


# Patterns given here are written for both notations and compare ASCII letters only.
OWN = frozenset(p.pattern for p in (*SECURITY_PATTERNS, *RULE_PATTERNS, *SAMPLE_SECURITY_PATTERNS, *SAMPLE_RULE_PATTERNS))


def spark_pattern(pattern: str) -> str | None:
    """``pattern``, written in Python's notation, as Spark's regular expressions want it: case ignored, and classes
    such as ``\\w`` reaching beyond ASCII as in Python. None if it does not compile in both."""
    try:
        names = re.compile(pattern).groupindex
    except re.error:
        return None
    if pattern in OWN:
        return "(?i)" + pattern
    out = pattern.replace(r"\Z", r"\z")
    for name in names:  # a name may hold an underscore in Python only
        plain = "g" + "".join(f"{ord(ch):x}x" if not ch.isascii() or not ch.isalnum() else ch for ch in name)
        out = out.replace(f"(?P<{name}>", f"(?<{plain}>").replace(f"(?P={name})", rf"\k<{plain}>")
    out = ("(?iuU)" if re.search(r"\\[wWdDsSbB]", pattern) else "(?iu)") + out
    session = SparkSession.getActiveSession()
    if session is None:
        return out
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(out)
    except (Py4JError, IllegalArgumentException):
        return None
    return out


def usable(catalog: list[Pattern]) -> list[Pattern]:
    """The entries whose pattern compiles, in Spark's notation; the others are skipped."""
    return [Pattern(p.name, translated, p.reason) for p in catalog if (translated := spark_pattern(p.pattern)) is not None]


def any_of(words: list[str]) -> str:
    """Alternation matching any of the literal words."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
