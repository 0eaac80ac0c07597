"""Credential and token patterns."""

from seepage.rules import Rule

MODULE = "secrets"

# Token formats.
RULES = [
    Rule("aws_key", "AWS Access Key", r"(?i)(AKIA[0-9A-Z]{16})", 1, ("akia",)),
    Rule("aws_secret", "AWS Secret Key", r"""(?i)(['\"])([A-Za-z0-9/+=]{40})\1""", 2),
    Rule("google_api", "Google API Key", r"(?i)(AIza[0-9A-Za-z\-_]{35})", 1, ("aiza",)),
    Rule("google_oauth", "Google OAuth", r"(?i)([0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com)", 1,
         (".apps.googleusercontent.com",),
         fast=r"(?i)(?:\G|(?<![0-9]))([0-9]++-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com)"),
    Rule("firebase", "Firebase URL", r"(?i)([a-zA-Z0-9-]+\.firebaseio\.com)", 1, (".firebaseio.com",), "host",
         fast=r"(?i)(?:\G|(?<![a-zA-Z0-9-]))([a-zA-Z0-9-]++\.firebaseio\.com)"),
    Rule("stripe_pk", "Stripe Publishable Key", r"(?i)(pk_live_[0-9A-Za-z]{24,})", 1, ("pk_live_",)),
    Rule("stripe_sk", "Stripe Secret Key", r"(?i)(sk_live_[0-9A-Za-z]{24,})", 1, ("sk_live_",)),
    Rule("slack_token", "Slack Token", r"(?i)(xox[baprs]-[0-9A-Za-z-]{10,})", 1, ("xox",)),
    Rule("github_token", "GitHub Token", r"(?i)(ghp_[0-9A-Za-z]{36})", 1, ("ghp_",)),
    Rule("github_old", "GitHub Old Token", r"(?i)(gho_[0-9A-Za-z]{36})", 1, ("gho_",)),
    Rule("gitlab_token", "GitLab Token", r"(?i)(glpat-[0-9A-Za-z\-_]{20,})", 1, ("glpat-",)),
    Rule("jwt", "JWT Token", r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, ("eyj",)),
    Rule("bearer", "Bearer Token", r"(?i)(bearer\s+[A-Za-z0-9\-._~+/]{20,})", 1, ("bearer",)),
    Rule("basic_auth", "Basic Auth", r"(?i)(basic\s+[A-Za-z0-9+/=]{20,})", 1, ("basic",)),
    Rule("twilio_sid", "Twilio SID", r"(?i)(AC[a-f0-9]{32})", 1),
    Rule("twilio_token", "Twilio Token", r"(?i)(SK[a-f0-9]{32})", 1),
    Rule("sendgrid", "SendGrid Key", r"(?i)(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})", 1, ("sg.",)),
    Rule("mapbox", "MapBox Token", r"(?i)(pk\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, ("pk.eyj",)),
    Rule("facebook_secret", "Facebook App Secret", r"(?i)([0-9a-f]{32})", 1, fast=r"([0-9a-fA-F]{32})"),
    Rule("recaptcha", "reCAPTCHA Key", r"(?i)(6L[0-9A-Za-z_-]{38})", 1, ("6l",)),
    Rule("sentry_dsn", "Sentry DSN", r"(https://[a-f0-9]{32}@[a-f0-9]{32}\.ingest\.sentry\.io/\d+)", 1,
         (".ingest.sentry.io/",), "scheme"),
]

# Default gates.
MIN_ENTROPY = 3.5
MIN_LENGTH = 8
TOKEN_TITLE_CHARS = 12
WINDOW = 60

# String shapes used when a token is classified.
BASE64_SHAPE = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
HEX_SHAPE = r"^[0-9a-fA-F]+$"

# A quoted run, or the value of an assignment, of token characters.
TOKEN = r"""(?:['"]|[=:][ \t]*)([A-Za-z0-9+/=_\-]{8,})"""
