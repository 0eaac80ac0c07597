"""Scoring tables."""

# Severities from worst to mildest; confidences with scores.
SEVERITIES = ["Critical", "High", "Medium", "Low", "Informational"]
CONFIDENCE_SCORES = {"Certain": 1.0, "High": 0.8, "Medium": 0.5, "Low": 0.3, "Speculative": 0.1}

# Order in which the detectors report.
MODULES = [
    "sensitive_file", "http_header", "source_code", "javascript", "secrets", "errors",
    "directory_listing", "api_docs", "git_exposure", "cloud_exposure", "metadata", "dns",
]

# Severity of a module at full confidence.
BASE_SEVERITY = {
    "secrets": "Critical", "git_exposure": "Critical",
    "sensitive_file": "High", "cloud_exposure": "High",
    "http_header": "Medium", "source_code": "Medium", "errors": "Medium",
    "directory_listing": "Medium", "api_docs": "Medium", "javascript": "Medium",
    "metadata": "Low", "dns": "Low",
}
DEFAULT_SEVERITY = "Medium"

# Modules whose hits are certain when the status is 200.
CERTAIN_MODULES = ["sensitive_file", "git_exposure", "secrets"]
REDIRECTS = [301, 302, 307, 308]

# Weakness and risk categories.
CWE = {
    "sensitive_file": "CWE-530", "http_header": "CWE-200", "source_code": "CWE-540", "javascript": "CWE-312",
    "secrets": "CWE-798", "errors": "CWE-209", "directory_listing": "CWE-548", "api_docs": "CWE-497",
    "git_exposure": "CWE-200", "cloud_exposure": "CWE-200", "metadata": "CWE-200", "dns": "CWE-200",
}
DEFAULT_CWE = "CWE-200"
OWASP = {
    "sensitive_file": "OWASP:API8", "http_header": "OWASP:API4", "source_code": "OWASP:API8",
    "javascript": "OWASP:API8", "secrets": "OWASP:API8", "errors": "OWASP:API7",
    "directory_listing": "OWASP:API8", "api_docs": "OWASP:API9", "git_exposure": "OWASP:API8",
    "cloud_exposure": "OWASP:API8", "metadata": "OWASP:API8", "dns": "OWASP:API3",
}
DEFAULT_OWASP = "OWASP:API8"

# CVSS vectors by module and severity.
CVSS = {
    ("sensitive_file", "Critical"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N/E:F/RL:O/RC:C",
    ("http_header", "High"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N/E:P/RL:O/RC:C",
    ("source_code", "High"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:L/I:N/A:N/E:F/RL:O/RC:C",
    ("secrets", "Critical"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H/E:F/RL:O/RC:C",
    ("errors", "Medium"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N/E:P/RL:O/RC:C",
    ("directory_listing", "Medium"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N/E:P/RL:O/RC:C",
    ("git_exposure", "Critical"): "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N/E:H/RL:O/RC:C",
}
DEFAULT_CVSS = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:N/A:N/E:P/RL:O/RC:C"

# Advice per module.
ADVICE = {
    "sensitive_file": "Remove sensitive files from the web root. Store configuration and credentials outside the document root. Use environment variables for secrets.",
    "http_header": "Configure the web server to suppress verbose headers. Use 'server_tokens off' (Nginx) or 'ServerTokens Prod' (Apache).",
    "source_code": "Remove sensitive comments from production code. Use build processes to strip development artifacts. Review and sanitize all output.",
    "javascript": "Never embed secrets in client-side code. Use server-side proxies. Implement strict CSP headers. Rotate any exposed credentials immediately.",
    "secrets": "Immediately revoke and rotate exposed credentials. Use a vault solution. Implement secret scanning in CI/CD. Never hardcode secrets.",
    "errors": "Disable debug mode in production. Implement custom error pages. Log errors server-side only. Never expose stack traces to clients.",
    "directory_listing": "Disable directory listing on the web server. Use index files or 'Options -Indexes' (Apache) or 'autoindex off' (Nginx).",
    "api_docs": "Restrict access to API documentation. Use authentication. Do not expose internal API schemas to unauthenticated users.",
    "git_exposure": "Remove .git directory from production. Block access via web server rules. Never deploy with version control metadata.",
    "cloud_exposure": "Review cloud resource configurations. Implement proper IAM policies. Use resource tagging and monitoring.",
    "metadata": "Remove metadata from public files. Use automated tools to sanitize documents before publishing.",
    "dns": "Review DNS records for exposed internal information. Remove unnecessary TXT records. Use minimal disclosure in DNS.",
}
DEFAULT_ADVICE = "Review and remediate the identified information disclosure."
