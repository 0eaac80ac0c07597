"""Patterns for comments, addresses and references in page source."""

from seepage.rules import Rule

MODULE = "source_code"

# Patterns and finding titles.
RULES = [
    Rule("html_comment", "HTML comment contains", r"<!--(.*?)-->", 1, ("<!--",), stop=r"-->"),
    Rule("todo", "Development comment found",
         r"(?i)(TODO|FIXME|XXX|HACK|BUG|WORKAROUND|TEMP|HARDCODE)\b[^.]*\.?", 1,
         ("todo", "fixme", "xxx", "hack", "bug", "workaround", "temp", "hardcode"),
         fast=r"(?i)(?=[TFXHBW])(TODO|FIXME|XXX|HACK|BUG|WORKAROUND|TEMP|HARDCODE)\b[^.]*\.?", tier="Low"),
    Rule("internal_url", "Internal/development URL exposed",
         r"(https?://(?:dev|stage|staging|qa|test|uat|internal|admin|private|local|jira|confluence|jenkins|gitlab|github|bitbucket)\.[^\s\"'>)\]]+)",
         1, gate="scheme", tier="Medium"),
    Rule("api_endpoint", "API endpoint exposed in source",
         r"(/api/v[0-9]+/[^\s\"'>)\]]+|/graphql[^\s\"'>)\]]*|/rest/v[0-9]+/[^\s\"'>)\]]+)", 1,
         ("/api/v", "/graphql", "/rest/v"), tier="Medium"),
    Rule("admin_path", "Admin panel path exposed",
         r"(/admin|/administrator|/wp-admin|/backend|/manager|/console|/dashboard|/panel|/cpanel)[/\s\"'>)\]]", 1,
         ("/admin", "/wp-admin", "/backend", "/manager", "/console", "/dashboard", "/panel", "/cpanel"),
         tier="Medium"),
    Rule("email", "Email address exposed in source", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0, ("@",),
         fast=r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", tier="Low"),
    Rule("phone", "Phone number exposed in source",
         r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
         fast=r"(?=[+(\d])(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}", tier="Low"),
    Rule("ip_address", "Internal IP address exposed", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
         fast=r"(?=[0-9])\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", tier="Low"),
    Rule("internal_hostname", "Internal hostname exposed",
         r"\b(?:dev-|stage-|qa-|test-|uat-)[a-zA-Z0-9-]+\.(?:local|internal|corp|lan)\b", 0,
         ("dev-", "stage-", "qa-", "test-", "uat-"), tier="Low"),
    Rule("s3_bucket", "S3 bucket URL exposed", r"\b[a-zA-Z0-9.-]+\.s3\.amazonaws\.com\b", 0,
         (".s3.amazonaws.com",), "host", opener=r"\b", skip=r"[a-zA-Z0-9.-]++", tier="High"),
    Rule("s3_bucket_name", "S3 bucket reference exposed", r"\b(?:s3://|amazonaws\.com/)[a-zA-Z0-9._-]+", 0,
         ("s3://", "amazonaws.com/"), tier="Low"),
    Rule("connection_string", "Database connection string exposed",
         r"(?i)(mongodb://|postgresql://|mysql://|redis://|amqp://|rabbitmq://)[^\s\"'>)\]]+", 1,
         ("mongodb://", "postgresql://", "mysql://", "redis://", "amqp://", "rabbitmq://"), "scheme", tier="Critical"),
]

# Placeholder domains that are not reported.
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "domain.com",
    "yourdomain.com", "test.com", "yourcompany.com",
]

# Gates and widths.
STATUSES = (200, 201, 202)
WINDOW = 50
MIN_CHARS = 3
TITLE_CHARS = 80
