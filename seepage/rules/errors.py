"""Error page patterns."""

from seepage.rules import Rule

MODULE = "errors"

# Patterns, names and rule severities.  ``fast`` and ``stop``
# are ours: an unbounded lazy gap that leads to the next fixed part never
# profits from a later choice, so it is written as an atomic group.  ``opener``
# is ours too.
RULES = [
    Rule("php_error", "PHP Error/Stack Trace",
         r"(?:Fatal error|Parse error|Warning|Notice|Deprecated):\s+.*?in\s+.*?\.php\s+on\s+line\s+\d+", 0, (".php",),
         stop=r"\.php\s+on\s+line\s+\d+",
         opener=r"(?:Fatal error|Parse error|Warning|Notice|Deprecated):\s",
         fast=r"(?:Fatal error|Parse error|Warning|Notice|Deprecated):\s++(?>.*?in\s++)(?>.*?\.php\s+on\s+line\s+\d++)",
         tier="Medium"),
    Rule("php_stack_trace", "PHP Stack Trace", r"#\d+\s+.*?\.php\(.*?\):\s+.*?\n", 0, (".php(",),
         opener=r"#\d+\s+", skip=r"[^\n]*+",
         fast=r"#\d+\s+(?>.*?\.php\()(?>.*?\):(?=\s))\s+.*?\n", tier="Medium"),
    Rule("python_traceback", "Python Traceback",
         r"Traceback\s*\(most recent call last\):.*?\n(?:.*\n)*?(?:\w+Error|\w+Exception)", 0, ("traceback",),
         stop=r"(?:\w+Error|\w+Exception)",
         fast=r"Traceback\s*\(most recent call last\):[^\n]*\n(?s:.*?)(?<=\n)(?:\w+Error|\w+Exception)", tier="High"),
    Rule("python_django_debug", "Django Debug Page", r"Django\s+version\s+\d+\.\d+.*?Python\s+executable", 0,
         ("django",), stop=r"Python\s+executable", tier="High"),
    Rule("python_flask_debug", "Flask Debug Page",
         r"Flask\s+DebugToolbar|The\s+debugger\s+caught\s+an\s+exception", 0, ("debugtoolbar", "debugger"),
         tier="High"),
    Rule("java_exception", "Java Exception",
         r"(?:Exception|Error) in thread \".*?\":?.*?(?:at\s+.*?\.java:\d+)", 0, (" in thread \"",),
         stop=r"\.java:\d+",
         opener=r"(?:Exception|Error) in thread \"",
         fast=r"(?:Exception|Error) in thread \"(?>.*?\"):?(?>.*?at\s++)(?>.*?\.java:\d++)", tier="High"),
    Rule("java_stack_trace", "Java Stack Trace", r"\s+at\s+[\w.]+\([\w.]+\.java:\d+\)", 0, (".java:",),
         fast=r"(?:\G|(?<!\s))\s++at\s+[\w.]++\([\w.]+\.java:\d+\)", tier="Medium"),
    Rule("java_spring_error", "Spring Error/Whitelabel",
         r"Whitelabel\s+Error\s+Page|This\s+application\s+has\s+no\s+explicit\s+mapping", 0,
         ("whitelabel", "explicit"), tier="Medium"),
    Rule("aspnet_error", "ASP.NET Error", r"Server\s+Error\s+in\s+['\"]?[^'\"]*['\"]?\s+Application", 0,
         ("application",), tier="Medium"),
    Rule("aspnet_ymlp", "ASP.NET Yellow Screen",
         r"<!--\s+Web\.config\s+Configuration\s+File\s+-->|\[HttpException\]:|Stack\s+Trace:", 0,
         ("web.config", "[httpexception]:", "trace:"), tier="Medium"),
    Rule("aspnet_version", "ASP.NET Version", r"ASP\.NET\s+version:\s+\d+\.\d+\.\d+", 0, ("asp.net",), tier="Low"),
    Rule("nodejs_error", "Node.js Error",
         r"(?:Error|TypeError|ReferenceError|SyntaxError):\s+.*?\n\s+at\s+\w+\s+\(.*?\.(?:js|ts|jsx|tsx):\d+:\d+\)",
         0, (".js:", ".ts:", ".jsx:", ".tsx:"), stop=r"\.(?:js|ts|jsx|tsx):\d+:\d+\)",
         opener=r"(?:Error|TypeError|ReferenceError|SyntaxError):\s",
         fast=r"(?:Error|TypeError|ReferenceError|SyntaxError):\s+(?>.*?\n\s+at\s+\w+\s+\()(?>.*?\.(?:js|ts|jsx|tsx):\d+:\d+\))",
         tier="Medium"),
    Rule("nodejs_stack", "Node.js Stack Trace", r"\s+at\s+\w+\s+\(.*?node_modules.*?:\d+:\d+\)", 0,
         ("node_modules",),
         opener=r"(?:\G|(?<!\s))\s++at\s++\w++\s++\(", skip=r"[^\n]*+",
         fast=r"(?:\G|(?<!\s))\s++at\s++\w++\s++\((?>.*?node_modules)(?>.*?:\d++:\d++\))", tier="Medium"),
    Rule("laravel_error", "Laravel Error",
         r"Laravel\s+[\d.]+\s+\(PHP\s+[\d.]+\)|Whoops\s*!\s*There\s+was\s+an\s+error", 0, ("laravel", "whoops"),
         tier="Medium"),
    Rule("rails_error", "Rails Error", r"Rails\s+root:\s+|Application\s+Trace|Framework\s+Trace|Full\s+Trace", 0,
         ("rails", "trace"), tier="Medium"),
    Rule("ruby_error", "Ruby Error",
         r"(?:NoMethodError|ArgumentError|RuntimeError|SyntaxError).*?\n.*?app/.*?:\d+:in", 0, ("app/",),
         stop=r":\d+:in",
         opener=r"(?:NoMethodError|ArgumentError|RuntimeError|SyntaxError)",
         fast=r"(?:NoMethodError|ArgumentError|RuntimeError|SyntaxError)(?>.*?\n)(?>.*?app/)(?>.*?:\d+:in)",
         tier="Medium"),
    Rule("go_panic", "Go Panic", r"panic:\s+.*?\n.*?goroutine\s+\d+.*?\n.*?\.go:\d+", 0, ("panic:",),
         stop=r"\.go:\d+",
         opener=r"panic:\s",
         fast=r"panic:\s+(?>.*?\n)(?>.*?goroutine\s+\d++)(?>.*?\n)(?>.*?\.go:\d++)", tier="Medium"),
    Rule("debug_mode", "Debug Mode Enabled",
         r"(?i)(debug\s*[=:]\s*true|APP_DEBUG\s*[=:]\s*true|DEBUG\s*=\s*True)", 0, ("debug",), tier="High"),
    Rule("sensitive_error_path", "Sensitive Path in Error",
         r"in\s+(?:/var/www|/home/|C:\\inetpub|/app|/srv|/usr/local|/opt)/\S+\.\w+:\d+", 0,
         ("/var/www", "/home/", "c:\\inetpub", "/app", "/srv", "/usr/local", "/opt"), tier="High"),
]

# Rules in which a dot stops at the end of the line.
LINE_RULES = ("php_stack_trace", "python_traceback", "nodejs_stack", "java_stack_trace")

# Gates and widths.
STATUSES = (200, 201, 202, 403, 404, 500)
MIN_CHARS = 10
