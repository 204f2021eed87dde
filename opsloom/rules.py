"""Rule tables.

Everything below is a set of FIXED VALUES: word lists, patterns, thresholds and
weights the results depend on.  Each is only a default; the operators take the
table as an argument.
"""

from __future__ import annotations

# --- whitespace and line ends, as Python's str.strip / str.splitlines see them (fixed values) ---
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# --- corpus (fixed values) ---
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
CHUNK_MIN_CHARS = 40
SECTION_MIN_CHARS = 40
BREADCRUMB_MIN_CHARS = 50
ROW_WINDOW = 4
ROW_STRIDE = 2
DOC_MAX_CHARS = 24_000
DOC_CUT_MARK = "\n\n[...truncated for context budget...]"
DOC_SUFFIXES = (".log", ".txt", ".json")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif")
CHUNK_TTL_DAYS = 30
CODE_FENCE = r"```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"
PAGE_DROP_TAGS = ("nav", "footer", "header", "aside", "form", "script", "style")
PAGE_MIN_WORDS = 15
PAGE_FIT_MIN_CHARS = 500
SERVICE_TAGS = ("ssh", "ftp", "http", "https", "smb", "nfs", "dns", "ldap", "snmp", "mysql", "postgres")
CATEGORY_TAGS = (
    ("exploitation", ("reverse", "shell", "payload", "exploit")),
    ("recon", ("enum", "scan", "recon", "nmap", "gobuster")),
    ("privilege-escalation", ("privilege", "privesc", "sudo", "suid")),
    ("networking", ("reverse shell", "port forward", "tunnel", "ssh")),
)
CATEGORY_DEFAULT = "general"
ENTRY_FIELDS = ("abuse", "code", "payload", "command", "commands")
PRIVESC_SOURCES = ("gtfobins", "lolbas")
REGISTRY_DEFAULTS = {"type": "general", "parse_mode": "markdown", "content_glob": "**/*.md"}

# --- walkthrough rows (fixed values) ---
MACHINE_PREFIX = "hackthebox - "
WALKTHROUGH_PHASES = (
    ("root", ("linpeas", "setuid", "sudo", "root", "privesc")),
    ("user", ("command injection", "reverse shell", "foothold", "ftp creds", "sshing", "exploit")),
    ("recon", ("nmap", "enum", "gobuster", "scan", "dirb", "ferox")),
)
WALKTHROUGH_PHASE_DEFAULT = "recon"

# --- retrieval (fixed values) ---
EMBEDDING_DIMS = 768
INDEX_ORDER = ("ippsec", "gtfobins", "lolbas", "hacktricks", "payloads")
SOURCE_ALIASES = {"gtfobs": "gtfobins"}
SOURCE_PHRASE = r"\bonly\s+(ippsec|gtfobs|gtfobins|lolbas|hacktricks|payloads)\b"
RESCUE_INDEX = "gtfobins"
MAX_QUERY_TERMS = 12
LEXICAL_DISTANCE = 0.55
RERANK_CANDIDATES = 10
SHOWN_TURNS = 3
SHOWN_TTL_SECONDS = 6 * 3600
CONFIDENT_SIMILARITY = 0.40
TOKEN_BUDGET = 1500
WEB_SNIPPET_CHARS = 300
WEB_MAX_RESULTS = 5
PHASE_WEIGHT, RERANK_WEIGHT, SIMILARITY_WEIGHT, SHOWN_PENALTY = 0.20, 0.65, 0.25, 0.30
SNIPPET_PHASES = (
    ("root", ("linpeas", "setuid", "sudo -l", "root flag")),
    ("user", ("reverse shell", "command injection", "foothold", "ftp creds", "ssh")),
    ("recon", ("nmap", "gobuster", "enumeration", "scan", "dirsearch")),
)
PHASE_BONUS = (
    ("recon", "networking", 0.3), ("recon", "enumeration", 0.2), ("recon", "discovery", 0.2),
    ("user", "exploit", 0.4), ("user", "payload", 0.3), ("user", "vulnerability", 0.2),
    ("root", "privesc", 0.5), ("root", "suid", 0.3), ("root", "capabilities", 0.2),
    ("unknown", "dump", 0.3), ("unknown", "hash", 0.3), ("unknown", "lateral", 0.2),
)
PHASE_BONUS_CAP = 0.5
PRIVESC_BONUS = (("gtfobins", 0.25), ("hacktricks", 0.22))
SHORT_TOOL_SOURCE, SHORT_TOOL_BONUS, SHORT_TOOL_CHARS = "gtfobins", 0.45, 4
GENERIC_HINTS = ("nmap", "gobuster", "dirsearch", "enumeration", "methodology", "cheatsheet", "general", "recon")
SUMMARY_KEYS = ("phase", "line", "tag", "academy", "video_id", "timestamp_seconds")
CVE_PATTERN = r"(?i)\bCVE-\d{4}-\d{4,}\b"
RECALL_LIMIT = 20

# --- command history (fixed values) ---
CONTEXT_LIMIT = 50
TOOLS = (
    "nmap", "gobuster", "feroxbuster", "ffuf", "nikto", "sqlmap", "dirsearch", "wfuzz", "smbclient", "smbmap",
    "enum4linux", "msfconsole", "netexec", "crackmapexec", "hydra", "john", "hashcat", "tcpdump", "wireshark",
    "nuclei",
)
TOOL_PREFIXES = ("nmap", "gobuster", "smb", "enum4linux")
CODE_PREFIXES = (
    "from ", "import ", "print(", "def ", "class ", "async def ", "await ", "return ", "for ", "try:", "except ",
    "if __name__", "with open",
)
HEREDOC_ENDS = ("PY", "EOF", "PYTHON")
SIGNAL_MAX_CHARS = 300
PROSE_MARKS = (
    "[green]", "[red]", "[magenta]", "[yellow]", "[grey", "[bold", "it looks like", "it seems like", "let me ",
    "the exploit", "you should", "try running", "this suggests", "note that",
)
FAILURE_MARKS = (
    "access denied", "permission denied", "command not found", "connection refused", "authentication failed",
    "no such file or directory", "nt_status_logon_failure", "exploit completed, but no session was created",
    "no session was created", "error:", "failed:", "timeout", "timed out", "refused",
)
SUCCESS_MARKS = (
    "root@", "id: uid=0", "uid=0(", "pwned", "shell spawned", "whoami\nroot", "access granted",
    "connection established", "session opened", "successfully", "complete", "done",
)
NAME_PATTERN = r"^[a-zA-Z][a-zA-Z0-9-]{0,23}$"
HOST_PATTERN = r"(?i)\b([a-zA-Z][a-zA-Z0-9-]{0,23})\.htb\b"
CD_SKIP = ("~", "-", "..", ".", "$HOME", "/", "")
HOST_ALIASES = ("localhost", "local", "host", "gateway")
JSON_FLAGS = ("-oj", "--json", "-ojson", "--output-format json")
JSON_TOOLS = ("nmap", "ffuf", "gobuster", "feroxbuster")
LONG_OUTPUT_CHARS = 220
COOLDOWN_SECONDS = 30
COACH_SECONDS = 10
SEEN_LIMIT = 200
PHASE_IDLE = "[IDLE]"
PHASE_RULES = (
    ("[POST-EXPLOITATION]", (r"(?i)\blinpeas\b", r"(?i)(^|\s)whoami(\s|$)", r"(?i)(^|\s)id(\s|$)")),
    ("[EXPLOITATION]", (
        r"(?i)\bnc\b", r"(?i)\bsearchsploit\b", r"(?i)\bmsfconsole\b", r"(?i)python3\s+-c\s+['\"]import\s+pty",
        r"(?i)python3.*(exploit|payload|reverse\s*shell|cve-\d{4}-\d+)",
    )),
    ("[ENUMERATION]", (r"(?i)\bgobuster\b", r"(?i)\bdirbuster\b", r"(?i)\bferoxbuster\b", r"(?i)\bnikto\b")),
    ("[RECON]", (r"(?i)\bnmap\b", r"(?i)\bmasscan\b")),
)
PHASE_BUCKETS = (
    ("[RECON]", "recon"), ("[ENUMERATION]", "recon"), ("[EXPLOITATION]", "user"), ("[POST-EXPLOITATION]", "root"),
)
EXPLOIT_PATTERNS = (
    r"(?i)\bsearchsploit\b", r"(?i)\bmsfconsole\b", r"(?i)\bmsf\s*>\s*use\b", r"(?i)python3?\s+\S+\.py\b",
    r"(?i)\bsqlmap\b", r"(?i)\bburpsuite\b|\bjava\s+-jar\s+burp\b",
)
RECON_PATTERNS = (
    r"(?i)nmap\b.+(-sV|-A\b|-sC|-p-)", r"(?i)\b(gobuster|feroxbuster|dirbuster|ffuf|wfuzz|nikto)\b",
    r"(?i)\b(smbclient|smbmap|enum4linux|crackmapexec|netexec)\b",
)
HINT_SECONDS = (600, 1200)
HINT_LEVELS = ("vague", "conceptual", "direct")
RETRY_SECONDS = 30
RETRY_THRESHOLD = 3
STALL_SECONDS = 600
STALLING_SHARE = 0.67
RABBIT_HOLE_COMMANDS = 20
PROGRESS_COMMANDS = 5
STUCK_TURNS = 5
SIMILAR_INPUT_SHARE = 0.60
STUCK_TEXTS = (
    "Status: User is stuck on command injection in the /ip parameter",
    "Status: User is stuck on command injection attempts",
    "Status: User is stuck on the /ip parameter behavior",
    "Status: User is stuck; prior hints did not produce progress",
)
RECON_SMB_PATTERN = r"(?i)(\b(?:\d{1,3}\.){3}\d{1,3}\b).*(smb|445|smbclient)"
RECON_TOOLS = ("nmap", "masscan", "gobuster", "feroxbuster", "nikto")
RECON_SUMMARY_TEXTS = ("that weird SMB share on ", "your recent recon command: ", "your last recon trail")
TIP_MARK = "💡 Tip: "
TOOL_SUGGESTIONS = (
    ("gobuster", "Consider ffuf or feroxbuster for better speed and flexibility with patterns."),
    ("dirb", "feroxbuster is much faster and more configurable than dirb."),
    ("nikto", "Consider using a custom scan with nmap NSE scripts for more targeted results."),
    ("sqlmap", "For complex exploitation, consider Burp Suite Pro or manual SQL injection analysis."),
    ("nc", "netcat works, but try socat or ncat for more features and stability."),
    ("hydra", "Consider more targeted approaches: medusa or custom scripts for specific services."),
    ("nmap", "Consider masscan for faster initial scanning or nmap NSE scripts for detailed analysis."),
    ("masscan", "For more detailed results, consider switching to nmap with custom scripts."),
    ("dirsearch", "feroxbuster or ffuf offer better performance and more features."),
    ("wfuzz", "Consider ffuf for faster directory brute-forcing."),
    ("ffuf", "Consider feroxbuster for better performance with large wordlists."),
    ("feroxbuster", "Consider ffuf for better speed or dirsearch for simplicity."),
    ("enum4linux", "Consider smbclient or smbmap for more targeted SMB enumeration."),
    ("smbclient", "Consider enum4linux or smbmap for more comprehensive SMB analysis."),
    ("smbmap", "Consider enum4linux or smbclient for more comprehensive SMB analysis."),
    ("msfconsole", "Consider using individual modules directly for faster exploitation."),
    ("netexec", "Consider crackmapexec for more detailed network analysis."),
    ("crackmapexec", "Consider netexec for more detailed network analysis."),
    ("john", "Consider hashcat for GPU-accelerated cracking."),
    ("hashcat", "Consider john for simplicity or hashcat for GPU acceleration."),
)

# --- tool output (fixed values) ---
BANNER_RULE = "==============================================================="  # 63 signs
MAX_ITEMS = 25
MAX_LINES = 80
OPEN_PORT = r"(?i)^(\d+)/(?:tcp|udp)\s+open\s+([a-zA-Z0-9_.-]+)(?:\s+(.*))?$"
FOUND_PATH = r"(?i)^(/\S+)\s+\(Status:\s*(\d{3})(?:\)\s*\[Size:\s*(\d+)\])?"
EDGE = r"(?i)([A-Za-z0-9_.$-]+)\s*[-=]>\s*([A-Za-z0-9_.$-]+)(?:\s*\(([^)]+)\))?"
EDGE_DEFAULT = "linked"
ANSI = r"\x1b\[[0-9;]*m"
PATH_STATUS_CODES = ("200", "301", "302", "403", "500")
INJECTION_WORDS = (
    "back-end dbms", "current user", "current database", "available databases", "parameter", "is vulnerable",
    "payload", "os-shell", "file system",
)
PRINCIPAL_WORDS = ("domain", "user", "group", "computer")
PRIVESC_COLOURS = ("red", "yellow")
PRIVESC_WORDS = ("cve-", "sudo -l", "capabilities", "writable", "nfs", "suid")
SUMMARY_TITLES = {
    "services": "Nmap Open Services", "services_rest": "Nmap Summary", "injection": "SQLMap Findings",
    "edges": "BloodHound Signals", "privesc": "LinPEAS High-Priority Findings",
}
SUMMARY_EMPTY = "no high-signal data"
COMPACT_RULES = {
    "nmap": ("nmap",), "bruteforce": ("gobuster", "ffuf"), "share": ("smbclient", "smbmap", "enum4linux"),
}
COMPACT_SCAN_DROP = ("starting nmap", "nmap done", "service detection performed", "read data files from")
COMPACT_SCAN_KEEP = ("host is up", "/tcp", "/udp", "nmap scan report for")
COMPACT_PATH_KEEP = ("status: 301", "status: 302", "status: 200")
COMPACT_SHARE_KEEP = ("disk", "ipc$", "sharename", "permissions", "nt_status")
FINDING_PATTERNS = (
    ("password", r"(?i)(?:password|passwd|pwd|secret)[\s:=]+([^\s\n]+)"),
    ("password", r"(?i)admin:([^\s\n]+)"),
    ("password", r"(?i)root:([^\s\n]+)"),
    ("port", r"(?i)(?:port|PORT)[\s:]*(\d+)(?:/(?:tcp|udp))?"),
    ("port", r"(?i)(?:listening on|open)[\s:].*?(\d{4,5})"),
    ("cve", r"(?i)(CVE-\d{4}-\d{4,})"),
    ("cve", r"(?i)(?:vulnerability|vuln|exploit).*?(CVE-\d{4}-\d{4,})"),
    ("user", r"(?i)(?:user|username)[\s:=]+([a-zA-Z0-9_-]+)"),
    ("user", r"(?i)(?:found user|user found)[\s:=]+([a-zA-Z0-9_-]+)"),
)
# For plain prose corpora: e-mail addresses, IPv4 addresses and token assignments.
FINDING_PATTERNS_PROSE = (
    ("user", r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+[A-Za-z0-9])"),
    ("service", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"),
    ("password", r"token = (\"[^\"]+\")"),
)
FINDING_REPORT_ORDER = ("password", "cve", "port", "user", "service", "config", "other")
FINDING_ICONS = {
    "password": "🔑", "port": "🔌", "cve": "🐛", "user": "👤",
    "service": "⚙️", "config": "⚙️", "other": "📝",
}
FINDING_ICON = "📌"
FINDING_TITLE = "## 🔍 Findings\n"
FINDING_NONE = "No findings extracted yet.\n"
FINDING_HEADINGS = {
    "password": "🔑 Credentials", "cve": "🐛 Vulnerabilities", "port": "🔌 Ports/Services", "user": "👤 Users",
    "service": "⚙️ Services", "config": "⚙️ Configuration", "other": "📝 Other",
}
MARKUP_TAGS = ("[red]", "[/red]", "[bold]", "[/bold]", "[dim]", "[/dim]")
NOT_FOUND = r"(?i)\b404\b|not\s+found"
PREVIEW_CHARS = 2000

# --- sessions (fixed values) ---
CONDENSE_AFTER, CONDENSE_WINDOW = 10, 8
CHARS_PER_TOKEN, PRUNE_SHARE, PRUNE_TARGET_SHARE = 3, 0.80, 0.60
CONTEXT_COMMANDS = 20
REPEAT_RATIO = 0.90
THOUGHT_KEEP, THOUGHT_READ, THOUGHT_CHARS = 200, 60, 4000
STATE_TTL_DAYS = 7
LEARNING_MIN_CHARS, LEARNING_TTL_DAYS, MARKER_TTL_DAYS = 20, 365, 14
SECRET_KEYS = ("authorization", "api_key", "token", "x-api-key")
REDACT_MIN_CHARS = 256
SHOW_REASONING = (
    r"(?i)\b(show|include|send|dump)\b.*\b(thought|reasoning|thinking)\b|\b(thought|reasoning|thinking)\s+buffer\b"
)
ASK_WRONG = r"(?i)\bwhat\s+am\s+i\s+doing\s+wrong\b"
THOUGHT_BLOCK = r"(?is)<thought>(.*?)</thought>"
PROBABLE_COMMANDS = (
    "nmap", "curl", "wget", "ffuf", "gobuster", "feroxbuster", "dirb", "dirsearch", "nikto", "sqlmap", "nc",
    "netcat", "python", "python3", "bash", "sh", "ssh", "ftp", "smbclient", "rpcclient", "redis-cli",
    r"docker(?:\s+compose)?", "git", "ls", "cat", "grep", "find", "chmod", "chown", "echo", "export", "cd", "cp",
    "mv", "awk", "sed",
)
