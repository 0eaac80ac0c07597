"""Document properties."""

MODULE = "metadata"

# Probed paths, in probe order.
PATHS = [
    "documentation.pdf", "manual.pdf", "guide.pdf", "report.pdf",
    "resume.pdf", "cv.pdf", "brochure.pdf", "whitepaper.pdf",
    "financial_report.xlsx", "budget.xlsx", "spreadsheet.xlsx",
    "presentation.pptx", "slides.pptx", "deck.pptx",
    "policy.docx", "procedures.docx", "contract.docx", "agreement.docx",
    "docs/manual.pdf", "docs/guide.pdf",
    "static/docs/manual.pdf",
    "uploads/document.pdf",
    "files/document.pdf",
    "assets/docs/manual.pdf",
]

# PDF information fields, matched without case.
PDF_FIELDS = ["Author", "Creator", "Producer", "Title", "Subject", "CreationDate", "ModDate"]
PDF_FIELD = r"/{field}\s*\(([^)]*)\)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_FAST = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
INTERNAL_PATH = r'/(?:var|home|Users|tmp|opt|etc|usr)/[^\s\(\)<>"]+'
SOURCE_EXTENSIONS = [".php", ".py", ".js", ".java", ".conf", ".ini", ".xml", ".json", ".yml"]
NO_AUTHOR = ["", "Unknown", "unknown"]

# Office core properties.
OFFICE_MEMBER = "docProps/core.xml"
OFFICE_FIELDS = [
    ("Author", r"<dc:creator>([^<]+)</dc:creator>"),
    ("LastModifiedBy", r"<cp:lastModifiedBy>([^<]+)</cp:lastModifiedBy>"),
    ("Created", r"<dcterms:created[^>]*>([^<]+)</dcterms:created>"),
    ("Modified", r"<dcterms:modified[^>]*>([^<]+)</dcterms:modified>"),
    ("Revision", r"<cp:revision>([^<]+)</cp:revision>"),
]
OFFICE_EXTENSIONS = [".docx", ".xlsx", ".pptx"]

# Author labels in other files, matched without case.
LABEL = r"(?:Author|Creator)\s*[:\-]\s*([^\r\n]{1,100})"

# Caps.
