"""Patterns for scripts."""

from seepage.rules import Rule

MODULE = "javascript"

# Script references and inline scripts in HTML.
SCRIPT_SRC = Rule("script_src", "script", r"""<script[^>]+src=["\']([^"\']+\.(?:js|min\.js|bundle\.js))["\']""", 1,
                  opener="<script[^>]", skip="[^>]*+")
INLINE_SCRIPT = Rule("inline_script", "inline script", r"<script[^>]*>(.*?)</script>", 1,
                     stop=r"</script>", opener="<script", skip="[^>]*+")

# Endpoint patterns.
ENDPOINTS = [
    Rule("internal_endpoint", "Internal endpoint",
         r"(https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})(:\d+)?(/[^\s\"'>)\]]*)?)",
         1, gate="scheme"),
    Rule("internal_hostname", "Internal hostname",
         r"(https?://[a-zA-Z0-9-]+\.(?:local|internal|corp|lan|dev|stage|staging|qa|test|uat)(:\d+)?(/[^\s\"'>)\]]*)?)",
         1, gate="scheme"),
    Rule("websocket", "WebSocket URL", r"(wss?://[^\s\"'>)\]]+)", 1, ("ws://", "wss://"), "scheme"),
    Rule("s3_endpoint", "AWS S3 endpoint",
         r"(https?://[a-zA-Z0-9-]+\.(?:s3|s3-[a-z0-9-]+)\.amazonaws\.com/[^\s\"'>)\]]+)", 1, (".amazonaws.com/",), "host"),
    Rule("api_gateway", "AWS API Gateway",
         r"(https?://[a-zA-Z0-9-]+\.(?:execute-api|lambda)\.(?:[a-z0-9-]+)\.amazonaws\.com/[^\s\"'>)\]]*)", 1,
         (".amazonaws.com/",), "host"),
    Rule("cloudfront", "CloudFront distribution", r"(https?://[a-zA-Z0-9-]+\.cloudfront\.net/[^\s\"'>)\]]*)", 1,
         (".cloudfront.net/",), "host"),
    Rule("azure_app", "Azure App Service", r"(https?://[a-zA-Z0-9-]+\.azurewebsites\.net/[^\s\"'>)\]]*)", 1,
         (".azurewebsites.net/",), "host"),
    Rule("azure_cdn", "Azure CDN", r"(https?://[a-zA-Z0-9-]+\.azureedge\.net/[^\s\"'>)\]]*)", 1,
         (".azureedge.net/",), "host"),
    Rule("cloud_function", "Google Cloud Function", r"(https?://[a-zA-Z0-9-]+\.cloudfunctions\.net/[^\s\"'>)\]]*)",
         1, (".cloudfunctions.net/",), "host"),
    Rule("gcp_storage", "GCP Storage", r"(https?://storage\.googleapis\.com/[^\s\"'>)\]]+)", 1,
         ("://storage.googleapis.com/",), "host"),
    Rule("graphql_api", "GraphQL/API endpoint",
         r"(https?://[a-zA-Z0-9-]+\.(?:graphql|playground|api)\.[^\s\"'>)\]]+)", 1,
         (".graphql.", ".playground.", ".api."), "scheme"),
]

# Environment references and configuration entries.
ENV = Rule(
    "env_var", "Environment variable reference",
    r"(?i)(process\.env\.([A-Za-z_][A-Za-z0-9_]*)|import\.meta\.env\.([A-Za-z_][A-Za-z0-9_]*)|__ENV__\.([A-Za-z_][A-Za-z0-9_]*))",
    0, ("process.env.", "import.meta.env.", "__env__."))
CONFIG = Rule(
    "config_secret", "Configuration secret found",
    r"(?i)(['\"](apiKey|apiSecret|api_key|api_secret|secret|password|token|privateKey|private_key)['\"]\s*[:=]\s*['\"]([^'\"]{8,})['\"])",
    0, ("apikey", "apisecret", "api_key", "api_secret", "secret", "password", "token", "privatekey", "private_key"))
CLOUD_CONFIG = Rule(
    "cloud_config", "Cloud configuration reference",
    r"(?i)(['\"](?:project_id|projectId|project_number|bucket|storageBucket|authDomain|databaseURL|messagingSenderId|appId|measurementId)['\"]\s*[:=]\s*['\"]([^'\"]+)['\"])",
    0, ("project_id", "projectid", "project_number", "bucket", "authdomain", "databaseurl", "messagingsenderid",
        "appid", "measurementid"))
# The key of a cloud configuration match is its first quoted part.
CLOUD_CONFIG_KEY = r"^['\"]([^'\"]+)['\"]"

# Gates and widths.
STATUSES = (200, 201, 202)
WINDOW = 60
TITLE_CHARS = 80
