"""Exposed git repositories."""

MODULE = "git_exposure"

# Probed paths, in probe order; the directory itself is last.
PATHS = [
    ".git/config", ".git/HEAD", ".git/index", ".git/logs/HEAD",
    ".git/refs/heads/master", ".git/refs/heads/main", ".git/refs/heads/develop", ".git/refs/remotes/origin/HEAD",
    ".git/description", ".git/info/exclude",
    ".gitignore", ".gitattributes", ".gitmodules",
    ".git/FETCH_HEAD", ".git/ORIG_HEAD", ".git/packed-refs",
]
DIRECTORY = ".git/"

# Content markers, searched line by line.
CONFIG_MARKERS = [r"\[core\]", r"\[remote", r"\[branch", r"repositoryformatversion", r"filemode", r"bare\s*=\s*false"]
HEAD_MARKERS = [r"ref:\s*refs/heads/", r"^[a-f0-9]{40}$"]
DIRECTORY_MARKERS = ["Index of", "HEAD", "config"]

# Paths reported as references.
REFERENCE_PATHS = [".git/logs/HEAD", ".git/refs/heads/master", ".git/refs/heads/main"]
MIN_INDEX_CHARS = 20
