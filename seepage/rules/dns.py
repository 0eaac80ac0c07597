"""DNS answers that disclose internal names or weak policies."""

MODULE = "dns"

# TXT patterns.
INTERNAL_IP = r"(?:^|\.)(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:$|\.)"
INTERNAL_HOST = r"(?:^|\.)(?:dev|stage|staging|qa|test|uat|internal|private|admin|jenkins|gitlab|jira|confluence|wiki|mail|vpn|ns[0-9]|dc[0-9]|db[0-9])(?:\.|$)"
SPF = r"v=spf1"
SPF_PARTS = ["include:", "redirect=", "a:", "mx:", "ptr:"]
SPF_INCLUDE = r"include:([^\s]+)"
DKIM = r"v=DKIM1"
DKIM_SELECTOR = r"s=([^\s;]+)"
DMARC = r"v=DMARC1"
DMARC_POLICY = r"p=(\w+)"

# Telling labels per record type.
SPF_LABELS = ["dev", "stage", "test", "internal", "mail"]
MX_LABELS = ["dev", "stage", "test", "internal", "local"]
CNAME_LABELS = ["dev", "stage", "staging", "test", "qa", "internal"]
PTR_LABELS = ["dev", "stage", "staging", "qa", "test", "uat", "internal"]

# Probed subdomain labels, in probe order.
SUBDOMAINS = [
    "dev", "stage", "staging", "qa", "test", "uat", "admin", "portal",
    "mail", "vpn", "remote", "intranet", "internal", "private",
    "jenkins", "gitlab", "jira", "confluence", "wiki",
    "api", "api-dev", "api-staging", "api-qa",
    "app", "app-dev", "app-staging",
    "dashboard", "monitor", "grafana", "kibana", "prometheus",
    "db", "database", "mysql", "postgres",
    "backup", "backups", "storage", "files",
    "s3", "bucket", "assets", "cdn",
]
