"""Directory listings."""

MODULE = "directory_listing"

# Markers (case matters) and their descriptions, first one wins.
MARKERS = [
    ("Index of /", "Apache/Nginx directory listing"),
    ("[PARENTDIR]", "Parent directory link"),
    ("<title>Index of", "Generic directory listing"),
    ("<title>Directory listing for", "Generic directory listing"),
    ("Directory Listing", "Generic directory listing"),
    ('<A HREF="?C=N;O=D">', "Apache directory listing sort control"),
    ('<a href="?C=N;O=D">', "Apache directory listing sort control"),
    ("Last modified</a>", "Directory listing details"),
    ("Parent Directory</a>", "Parent directory navigation"),
]

# Well-known directories; the first 20 are probed.
DIRECTORIES = [
    "backup", "backups", "admin", "administrator", "uploads", "files",
    "images", "img", "css", "js", "assets", "static", "public",
    "download", "downloads", "docs", "documentation", "logs", "log",
    "temp", "tmp", "cache", "data", "private", "restricted",
    "api", "v1", "v2", "v3", "graphql", "swagger", "redoc",
    ".git", ".svn", ".hg", ".idea", ".vscode",
    "node_modules", "vendor", "bower_components",
    "wp-content", "wp-includes", "wp-admin",
    "src", "dist", "build", "config", "configuration",
    "test", "tests", "testing", "dev", "development",
    "stage", "staging", "qa", "uat",
    "phpmyadmin", "phpPgAdmin", "adminer",
    "server-status", "server-info",
]

HREF = r"""<a\s+[^>]*href\s*=\s*["\']([^"\']+)["\']"""

# Thresholds and evidence shape.
MIN_DIRECTORIES = 5
