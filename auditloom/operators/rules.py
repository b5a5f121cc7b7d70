"""Rules over lines: a catalogue as data, unrolled into one projection; the first hit per diff and rule.

Patterns are literals of the plan, compiled once per task; nothing is joined on a pattern.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.recipe import BUILD_FUNCTIONS, HOOKS, LINE_CHARS


@dataclass(frozen=True)
class Rule:
    """A pattern over the lines of a diff. target: raw body or resolved text; scope: contexts or functions, () for all.

    A rule without a pattern holds where the words of a line's commands meet it, see functions/commands.py.
    """

    id: str
    name: str
    pattern: str
    severity: str
    category: str
    target: str = "resolved"
    scope: tuple[str, ...] = ()
    added_only: bool = True
    comments: bool = False
    unless: str = ""
    stage: str = ""


_SHELL = r"(?:(?:/\S*/)?(?:ba|z|da|k|a)?sh|busybox\s+sh)\b"
_RUNNER = rf"(?:sudo\s+|env\s+){{0,5}}(?:{_SHELL}|(?:python|perl|ruby|node)[0-9.]*\b|source\s+/dev/stdin)"
_PIPE = r"(?<!\\)\|\s*"
_CLIENT = r"(?:curl|wget2?|aria2c|axel|lftp|ftp|nc|ncat|socat)\b"
_ABSOLUTE = r"(?:(?<=\s)|(?<=\s[\"']))/"
_CODE = ("function_body", "other")
_RUN = (*BUILD_FUNCTIONS, *HOOKS)

# The JVM's regular expressions recurse on repeated groups, so groups are repeated a bounded number of times only.
#: The catalogue: what each rule is after is its name. R001, R002, R007, R010, R011 and R046 are fixed values, too short to be said otherwise.
RULES = (
    Rule("R001", "Download run by an interpreter", rf"\bcurl\b.*{_PIPE}{_RUNNER}", "CRITICAL", "network_execution", stage="execution"),
    Rule("R002", "Fetch piped to a shell", rf"\bwget\b.*{_PIPE}{_RUNNER}", "CRITICAL", "network_execution", stage="execution"),
    Rule("R003", "Base64 decoded into a pipe", rf"\bbase64\b[^|]*\s(?:-d|-D|--decode)\b.*{_PIPE}", "CRITICAL", "obfuscation", stage="evasion"),
    Rule("R007", "Install file modified", r"\.install\b", "MEDIUM", "installer", "raw", stage="persistence"),
    Rule("R008", "Runtime runs a url", r"\b(?:python|ruby|perl)[0-9.]*\s+-c\s+[\"']?https?://", "HIGH", "network_execution", stage="execution"),
    Rule("R009", "Becomes another user", r"(?:^|[;&|]\s*)\s*(?:sudo|doas|pkexec)\s", "CRITICAL", "privilege", scope=_RUN, stage="escalation"),
    Rule("R010", "curl is called", r"\bcurl\s", "LOW", "network_usage", "raw", ("function_body",), stage="delivery"),
    Rule("R011", "wget is called", r"\bwget\s", "LOW", "network_usage", "raw", ("function_body",), stage="delivery"),
    Rule("R012", "Text addressed to a reading model", r"\b(?:ignore|disregard|forget)\s+(?:\w+\s+){0,2}(?:previous|prior|above|earlier)\b|</?(?:system|instructions?)\s*>|\b(?:classify|mark|treat|report)\b[^.]{0,24}\bas\s+(?:safe|benign|clean)\b", "FATAL", "injection", comments=True, added_only=False, stage="evasion"),
    Rule("R013", "Bidirectional or invisible characters", r"[\u202A-\u202E\u2060-\u2064\u2066-\u2069]|[\x21-\x7E][\u200B-\u200F\uFEFF][\x21-\x7E]", "FATAL", "unicode", "raw", comments=True, added_only=False, stage="evasion"),
    Rule("R017", "Special bit by letters", r"\bchmod\b[^;&|]*\+s", "HIGH", "privilege", "raw", _CODE, unless=r"\bchmod\s+\S+\s+\S", stage="escalation"),
    Rule("R039", "Eval of what a variable holds", r"\beval\s+[\"']?(?:\$|`)", "CRITICAL", "execution", stage="execution"),
    Rule("R040", "Inline shell code made of variables", rf"\b{_SHELL}\s+-c\s+[\"']?[^\"']*(?:\$[\w({{]|`)", "CRITICAL", "execution", stage="execution"),
    Rule("R041", "Socket opened by a path", "", "CRITICAL", "network_execution", stage="command_and_control"),
    Rule("R042", "Fetched file is run", "", "CRITICAL", "execution", stage="execution"),
    Rule("R043", "Base64 of a variable or here-text decoded", "", "CRITICAL", "obfuscation", stage="evasion"),
    Rule("R044", "Inline code reaches the network", "", "HIGH", "network_execution", stage="execution"),
    Rule("R045", "Bytes decoded from text and piped on", rf"\b(?:xxd|uudecode)\b[^|]*{_PIPE}", "MEDIUM", "obfuscation", stage="evasion"),
    Rule("R046", "Url of a bare address", r"\bhttps?://(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "MEDIUM", "network", "raw", stage="delivery"),
    Rule("R047", "Url with an unusual port", "", "LOW", "network", "raw", stage="delivery"),
    Rule("R048", "Url below a free registrar's domain", "", "LOW", "network", "raw", stage="delivery"),
    Rule("R049", "Foreign plugin or loader in the build", "", "MEDIUM", "build", "raw", stage="execution"),
    Rule("R050", "Build hardening switched off", "", "MEDIUM", "build", "raw", stage="evasion"),
    Rule("R051", "pkgver reaches the network", rf"\b{_CLIENT}", "HIGH", "packaging", "raw", ("pkgver",), stage="delivery"),
    Rule("R052", "Hidden file put into a home", "", "HIGH", "persistence", "raw", _CODE, stage="persistence"),
    Rule("R053", "Setuid, setgid or capability on a packaged file", "", "MEDIUM", "privilege", "raw", _CODE, stage="escalation"),
    Rule("R054", "Autostart unit written", r"(?:\b(?:install|cp|mv|ln|tee|cat|printf|echo)\b|>)[^;&|]*/(?:etc/(?:cron\.\w+|systemd/(?:system|user)|profile\.d|xdg/autostart|sudoers\.d|ld\.so\.conf\.d|pam\.d|init\.d)|usr/lib/systemd/(?:system|user)|var/spool/cron)/", "HIGH", "persistence", "raw", _CODE, stage="persistence"),
    Rule("R055", "Clone follows a variable", r"\bgit\s+clone\s[^;&|]*(?:--branch|-b)[\s=]+[\"']?\$", "MEDIUM", "source", stage="delivery"),
    Rule("R056", "Fetched file is read into the shell", "", "CRITICAL", "execution", stage="execution"),
    Rule("R057", "Certificates not checked", "", "HIGH", "network", stage="delivery"),
    Rule("R058", "System folder written to directly", "", "HIGH", "system", "raw", _CODE, stage="persistence"),
    Rule("R059", "Setuid, setgid or capability on the running system", "", "HIGH", "privilege", "raw", _CODE, stage="escalation"),
    Rule("R062", "Hook fetches or executes", rf"\b{_CLIENT}|\bchmod\s+u\+s|\bsystemctl\s+(?:enable|start)", "HIGH", "installer", scope=HOOKS, stage="execution"),
    Rule("R063", "Patch from outside the build tree", r"\b(?:patch|git\s+apply)\b[^;&]*(?:https?://|<\(|\s[\"']?/(?!dev/))", "HIGH", "integrity", scope=BUILD_FUNCTIONS, stage="delivery"),
    Rule("R070", "Loader environment changed", r"\b(?:LD_PRELOAD|LD_LIBRARY_PATH)\s*\+?=", "HIGH", "build", scope=BUILD_FUNCTIONS, stage="execution"),
    Rule("R077", "Write to a home or shell start file", r">>?\s*[\"']?(?:\$\{?HOME\}?|~)?/?\S*\.(?:bashrc|zshrc|profile|bash_profile|config/)", "HIGH", "persistence", scope=_RUN, stage="persistence"),
    Rule("R081", "Foreign package manager in a hook", r"(?:^|[;&|]\s*)\s*(?:pip3?|npm|pnpm|yarn|bun|gem|cargo|go)\s+(?:install|add|i|get)\b", "HIGH", "installer", scope=HOOKS, stage="delivery"),
    Rule("R084", "World-writable staging", r"(?:>>?\s*|\b(?:cd|cp|mv|install|tee)\s[^;&|]*)[\"']?/(?:tmp|var/tmp|dev/shm)/", "HIGH", "staging", scope=_RUN, unless=r"\bmktemp\b", stage="staging"),
    Rule("R085", "Service started from a writable path", r"\bExecStart\w*=\s*[-@+!]*[\"']?(?:/tmp|/var/tmp|/dev/shm|/run|\$\{?HOME\}?)/", "HIGH", "persistence", stage="persistence"),
    Rule("R086", "Host reconnaissance", r"(?:^|[;&|(]\s*)\s*(?:whoami|hostname|id|uname\s+-a|ifconfig|ip\s+a\w*|lscpu|dmidecode)\b", "INFO", "recon", scope=_RUN, stage="recon"),
    Rule("R114", "Package manager hook installed", r"/usr/share/libalpm/hooks/", "MEDIUM", "persistence", stage="persistence"),
    Rule("R119", "Anti-analysis check", r"\bTracerPid\b|\bsystemd-detect-virt\b|/sys/class/dmi/|\$\{?(?:GITHUB_ACTIONS|CI|CONTAINER)\b|/\.dockerenv", "HIGH", "evasion", scope=_RUN, stage="evasion"),
    Rule("R123", "Covert egress", r"\b[a-z2-7]{16,56}\.onion\b|\.i2p\b|\bdns-query\b|(?:^|[;&|]\s*)\s*(?:torsocks|ngrok|chisel|frpc)\b", "HIGH", "network", stage="exfiltration"),
    Rule("R127", "Indirect remote execution", rf"\b{_SHELL}\s+<\(\s*(?:curl|wget)|\b(?:curl|wget)\b.*{_PIPE}xargs\s+{_SHELL}|<<<\s*[\"']?\$\((?:curl|wget)", "CRITICAL", "network_execution", stage="execution"),
    Rule("R132", "Variable named by a variable", r"\$\{!\w+\}", "CRITICAL", "obfuscation", "raw", stage="evasion"),
    Rule("R144", "Packaged file points at a world-writable path", r"^(?=.*\$\{?pkgdir\b)(?=.*/(?:tmp|var/tmp|dev/shm)/)", "HIGH", "persistence", "raw", _CODE, stage="persistence"),
    Rule("R151", "Boot artifact from the source tree", r"\b(?:dracut|mkinitcpio|update-initramfs|grub-mkconfig|grub-install|bootctl)\b[^;&|]*\$\{?(?:srcdir|startdir|PWD|pkgdir)\b", "HIGH", "persistence", stage="persistence"),
    Rule("S001", "Recursive self-spawn", r":\s*\(\)\s*\{.*\|.*&.*\}|\bwhile\s+(?:true|:)\s*;\s*do\b[^;]*&", "CRITICAL", "sabotage", stage="impact"),
    Rule("S002", "Recursive deletion outside the build tree", r"\brm\s+(?:-\w*r\w*f\w*|-\w*f\w*r\w*|-r\s+-f|-f\s+-r)\s+(?:--\s+)?[\"']?(?:/(?:\s|$|\*|etc|usr|home|var|boot|root)|~|\$\{?HOME\b)", "CRITICAL", "sabotage", unless=r"\$\{?(?:srcdir|pkgdir|builddir)\b", stage="impact"),
    Rule("S003", "Raw block device write", r"\bdd\b[^;&|]*\bof=/dev/(?:sd|nvme|vd|mmcblk|mem)|\b(?:mkfs(?:\.\w+)?|wipefs|blkdiscard|sgdisk|shred)\b[^;&|]*/dev/(?:sd|nvme|vd|mmcblk)", "CRITICAL", "sabotage", stage="impact"),
    Rule("S005", "Permission change on a system path", r"\bchmod\s+(?:-\S+\s+){0,20}(?:0?777|a\+rwx)\s+[\"']?/(?:etc|usr|var|home)|\bchown\s[^;&|]*\s/(?:etc|usr|boot)", "HIGH", "sabotage", unless=r"\$\{?(?:srcdir|pkgdir)\b", stage="impact"),
    Rule("S006", "System service disrupted", r"\bsystemctl\s+(?:stop|disable|mask|isolate|poweroff|reboot|halt)\b|\b(?:killall|pkill)\s+\w*d\b|\bufw\s+disable\b", "HIGH", "sabotage", stage="impact"),
    Rule("S007", "Cryptocurrency miner", r"\bstratum\+(?:tcp|ssl)://|--donate-level\b|(?:^|[;&|/]\s*)(?:xmrig|minerd|cpuminer)\b", "HIGH", "sabotage", stage="impact"),
    Rule("S008", "History or log destroyed", r"\bhistory\s+-c\b|\bunset\s+HISTFILE\b|\bset\s+\+o\s+history\b|\bjournalctl\s+--vacuum|>\s*/var/log/", "MEDIUM", "sabotage", stage="evasion"),
    Rule("X004", "Build output suppressed", r"\bTERM=[\"']?dumb\b|\bset\s+\+o\s+xtrace\b|\bexec\s+[0-9]*>\s*/dev/null", "MEDIUM", "evasion", "raw", _RUN, stage="evasion"),
    Rule("X008", "Unusual white space", r"[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\x0B\x0C\x85]", "MEDIUM", "evasion", "raw", _RUN, stage="evasion"),
    Rule("X013", "Fetch redirected or trust replaced", r"\b(?:https?_proxy|ALL_PROXY)=|--(?:resolve|connect-to|doh-url|cacert)\b|\b(?:SSL_CERT_FILE|CURL_CA_BUNDLE)=", "HIGH", "evasion", "raw", _RUN, stage="delivery"),
    Rule("X015", "Work scheduled for later", r"(?:^|[;&|]\s*)\s*(?:crontab|at\s+now|batch|systemd-run|incrontab)\b|\bsystemctl\s+enable\s+--now\b", "HIGH", "evasion", "raw", _RUN, stage="persistence"),
    Rule("R087", "Upload to a file-drop host", r"\b(?:curl|wget)\b.*(?:\s-[FTd]\b|--(?:form|upload-file|data\S*|post-file)\b).*\b(?:transfer\.sh|0x0\.st|file\.io|pastebin\.com|paste\.rs|termbin\.com|ix\.io|anonfiles\.com|gofile\.io|discord(?:app)?\.com/api/webhooks|api\.telegram\.org)\b", "HIGH", "network", scope=_RUN, stage="exfiltration"),
    Rule("R088", "Hidden file dropped", r"(?:>>?\s*|\b(?:install|cp|mv|tee)\s[^;&|]*\s)[\"']?/(?!dev/|tmp/|var/tmp/)\S*/\.[\w-]+[\"']?\s*(?:$|[;&|])", "HIGH", "staging", scope=_RUN, unless=r"\$\{?(?:srcdir|pkgdir)\b", stage="staging"),
    Rule("R117", "Literal spelled by escapes", r"\$'[^']*\\(?:x[0-9A-Fa-f]{2}|[0-7]{3})|\$\(printf\s+[\"'][^\"']*\\x", "INFO", "obfuscation", "raw", stage="evasion"),
    Rule("R128", "Write outside the staging root", rf"(?:>>?\s*[\"']?/(?!dev/|tmp/|var/tmp/|proc/)|\b(?:install|cp|mv|tee)\s[^;&|]*{_ABSOLUTE}(?!dev/|tmp/|var/tmp/|usr/share/|proc/))", "HIGH", "staging", scope=BUILD_FUNCTIONS, unless=r"\$\{?(?:srcdir|pkgdir)\b|\bDESTDIR\b", stage="persistence"),
    Rule("R131", "Build flags weakened", r"\b(?:C|CXX|CPP|LD|RUST|MAKE)FLAGS\s*\+?=.*(?:-fno-stack-protector|-U_FORTIFY_SOURCE|-D_FORTIFY_SOURCE=0|-no-pie|-z\s*,?\s*norelro)", "HIGH", "build", "raw", stage="evasion"),
    Rule("R145", "Packaged file names a build-only path", r"\b(?:printf|echo|cat|tee)\b[^>]*\$\{?(?:srcdir|startdir|PWD|BUILDDIR)\b[^>]*>>?\s*[\"']?\$\{?pkgdir\b", "HIGH", "persistence", "raw", _RUN, stage="persistence"),
    Rule("S004", "Secure deletion of user data", r"\b(?:shred|srm|wipe)\b[^;&|]*(?:\$\{?HOME\}?|~|/home/|/root/)", "HIGH", "sabotage", unless=r"\$\{?(?:srcdir|pkgdir)\b", stage="impact"),
    Rule("W002", "Dependencies resolved from a registry", r"(?:^|[;&|]\s*)\s*(?:npm|pnpm|yarn|bun)\s+(?:ci|install|i)\b|\bpip3?\s+install\s+(?:-\S+\s+){0,20}-r\b|\bcargo\s+fetch\b|\bgo\s+mod\s+download\b|\bbundle\s+install\b", "INFO", "unverifiable", scope=_RUN, stage="delivery"),
    Rule("W004", "Unread build manifest", r"\b(?:make|gmake|ninja|bazel|scons)\b[^;&|]*\s(?:-f|--file|--makefile)[=\s]", "INFO", "unverifiable", scope=_RUN, stage="execution"),
    Rule("W006", "Generated file names a build-only path", r"\b(?:printf|echo|cat|tee)\b[^>]*\$\{?(?:srcdir|startdir|PWD|BUILDDIR)\b[^>]*>", "INFO", "unverifiable", "raw", _RUN, unless=r">>?\s*[\"']?\$\{?pkgdir\b", stage="staging"),
    Rule("X001", "Encoded payload decoded and executed", rf"(?:\bxxd\s+-r|\bod\s+-An|\bbase32\s+-d|\bbasenc\b|\bopenssl\s+enc\s+-d|\buudecode\b|\btr\s+[\"']?A-Za-z|\bprintf\s+[\"'](?:\\x|\\[0-7]{{3}}))[^|]*{_PIPE}.*{_RUNNER}", "CRITICAL", "evasion", "raw", _RUN, stage="evasion"),
    Rule("X002", "Command word that is no literal", r"(?:^|[;&|]\s*)\s*(?:\$\{?!?[A-Za-z_]\w*(?:\[[^\]]*\])?\}?|\$\([^)]*\)|`[^`]*`|\w+\{[^}\s]*,[^}\s]*\}|/\S*\w[?*\[]\S*)(?=\s+[\w./-])", "CRITICAL", "evasion", scope=_RUN, unless=r"^\s*[A-Za-z_]\w*\+?=", stage="evasion"),
    Rule("X003", "Obfuscated argument", r"\b(?:curl|wget)\b.*\s--(?:upload-f|outp|inse|loca|head|data-b)\b(?!\w)|\b(?:ba|z|da|k)?sh\s+-(?=\w*c)\w{2,}\s|https?://(?:0x[0-9a-f]+|0[0-7]+\.[0-9.]+|[0-9]{8,10})[/:]", "HIGH", "evasion", "raw", _RUN, stage="evasion"),
    Rule("X005", "Home by another spelling", r"(?:>>?\s*|\b(?:install|cp|mv|tee)\s[^;&|]*\s)[\"']?(?:/home/[\w$]+|~\w+|/root\b|\$\{HOME:-)", "HIGH", "evasion", scope=_RUN, unless=r"\$\{?(?:srcdir|pkgdir)\b", stage="persistence"),
    Rule("X006", "Source behind a shortener", r"\bhttps?://(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|is\.gd|v\.gd|rb\.gy|cutt\.ly|ow\.ly)/", "HIGH", "evasion", "raw", stage="delivery"),
    Rule("X010", "One-liner reaches the network", r"\b(?:python|perl|ruby|node|php)[0-9.]*\s+-[cer]\s.*(?:urlopen|requests\.get|file_get_contents|socket\.connect|LWP|fetch\()", "HIGH", "evasion", "raw", _RUN, stage="delivery"),
    Rule("X011", "Package manager runs fetched code", r"(?:^|[;&|]\s*)\s*(?:npm|pnpm|yarn|bun)\s+(?:install|i|add)\s+[\w@]|\bpip3?\s+install\s+[\w]|\b(?:cargo|go|gem|composer)\s+install\s+[\w]|\bnpx\s+\w|\bdeno\s+run\s+https?:", "HIGH", "evasion", "raw", _RUN, unless=r"\s\.{1,2}(?:/|\s|$)|--no-index|\$\{?srcdir", stage="execution"),
    Rule("X012", "Toolchain redirected into the source tree", r"\b(?:CC|CXX|LD|AR|PATH|LD_PRELOAD|LD_LIBRARY_PATH|PYTHONPATH|MAKEFLAGS)=[\"']?\$\{?(?:srcdir|startdir|pkgdir)\b", "HIGH", "evasion", "raw", _RUN, stage="execution"),
    Rule("X014", "Variable names code to run", r"\b(?:BASH_ENV|PROMPT_COMMAND|PS4|GIT_SSH_COMMAND|LESSOPEN|LD_AUDIT|GCONV_PATH|RUBYOPT|PERL5OPT|PYTHONSTARTUP|LUA_INIT)=|\bgit\s+config\b.*\b(?:core\.fsmonitor|diff\.external|credential\.helper|filter\.\S+\.clean)\b|\bProxyCommand\b", "HIGH", "evasion", "raw", _RUN, stage="execution"),
    Rule("X017", "Flag or builtin carries a command", rf"\btar\b.*--(?:checkpoint-action=exec|to-command)=|\bfind\b.*-exec\s+{_SHELL}|\benable\s+-f\s|\bhash\s+-p\s", "HIGH", "evasion", "raw", _RUN, stage="execution"),
    Rule("X018", "One-liner assembles a name", r"\b(?:python|perl|ruby|node|php)[0-9.]*\s+-[cer]\s.*(?:getattr\(\s*__import__|import_module\(|[\"']\s*\+\s*[\"']|\bexec\b.*\$\{?srcdir)", "HIGH", "evasion", "raw", _RUN, stage="evasion"),
    Rule("X019", "Host material sent or packaged", r"(?:^|[;&|]\s*)\s*(?:dig|nslookup|host|drill)\b.*\$\(|\bping\b.*-p\s*[\"']?\$\(|(?:/etc/machine-id|/etc/hostname|\.ssh/|\.bash_history)\S*.*\$\{?pkgdir\b", "HIGH", "evasion", "raw", _RUN, stage="exfiltration"),
    Rule("X020", "Recipe writes build steps", r"\b(?:printf|echo|cat|tee)\b.*(?:>>?|\btee\b)\s*[\"']?\S*(?:Makefile|build\.ninja|BUILD\.bazel|meson\.build|\.mk)\b", "HIGH", "evasion", "raw", _RUN, stage="execution"),
    Rule("X021", "Runs a file chosen at runtime", r"\b(?:ba|z|da|k)?sh\s+[\"']?(?:\$\{?[0-9*@]|\$\{\w+\[|[\w./]*\*)", "HIGH", "evasion", "raw", _RUN, unless=r"\bexec\s+[\"']?\$@", stage="execution"),
)

#: Programs at the ends of pipelines. Consumers take a download as data.
_CLIENTS = ("curl", "wget", "wget2", "aria2c", "axel", "lftp", "ftp", "nc", "ncat", "socat", "ssh", "dig", "openssl", "rsync", "scp", "telnet")
_SHELLS = ("sh", "bash", "zsh", "dash", "ksh", "ash", "mksh", "yash")
_RUNNERS = (*_SHELLS, "python", "python2", "python3", "perl", "ruby", "node", "php", "lua")
_CONSUMERS = (
    "tar", "bsdtar", "gzip", "gunzip", "zcat", "xz", "unxz", "zstd", "bzip2", "cpio", "unzip", "sha256sum", "sha512sum", "md5sum", "b2sum", "gpg", "tee", "cat", "grep", "sed", "awk", "tr", "cut", "sort", "uniq", "head", "tail", "wc",
    "jq", "less", "more", "patch", "install", "dd", "xargs", "column", "od", "xxd", "base64", "true",
)
#: Signs of obfuscation, of which three in one line are a finding.
_DENSITY = (r"\beval\b", r"\bbase64\b", r"\\x[0-9A-Fa-f]{2}", r"\$\{!?\w+[:#%/^,]", r"\bxxd\b", r"\$'", r"\brev\b", r"\btr\s", r"\$\(\s*printf", r"`")


def _pipelines() -> list[tuple[str, str, str, Column]]:
    """Rules over the ends of a line's pipeline and over the density of signs: id, severity, category, condition."""
    run = F.array(*(F.lit(f) for f in _RUN))
    inside = (F.col("side") == "+") & F.coalesce(F.arrays_overlap(F.concat(F.array(F.coalesce("function", F.lit(""))), F.coalesce("callers", F.array().cast("array<string>"))), run), F.lit(False))
    first, last = F.col("pipe_from"), F.col("pipe_to")
    signs = sum((F.col("_raw").rlike(p).cast("int") for p in _DENSITY), F.lit(0))
    return [
        ("X009", "CRITICAL", "evasion", inside & first.isin(*_CLIENTS) & ~first.isin("curl", "wget") & last.isin(*_RUNNERS)),
        ("X016", "HIGH", "evasion", inside & first.isin(*_CLIENTS) & ~last.isin(*_RUNNERS, *_CONSUMERS)),
        ("X023", "HIGH", "evasion", inside & last.isin(*_SHELLS) & ~first.isin(*_CLIENTS)),
        ("R082", "MEDIUM", "obfuscation", inside & ~F.col("body").rlike(r"^\s*#") & (signs >= 3)),
        ("R129", "HIGH", "network", (F.col("side") == "+") & F.col("function").isNull() & F.coalesce("file", F.lit("PKGBUILD")).rlike(r"PKGBUILD$|\.install$") & F.col("_resolved").rlike(r"(?:\$\(|`|^\s*)(?:curl|wget2?|aria2c|nc)\s")),
    ]


def _applies(rule: Rule) -> Column:
    """On which lines a rule looks: side, comments, context or function with its callers."""
    text = F.col("_raw") if rule.target == "raw" else F.col("_resolved")
    ok = text.isNotNull() & F.col("side").isin(*(["+"] if rule.added_only else ["+", " ", "-"]))
    if not rule.comments:
        ok &= ~F.col("body").rlike(r"^\s*#")
    if rule.scope:
        wanted = F.array(*(F.lit(s) for s in rule.scope))
        ok &= F.arrays_overlap(F.concat(F.array(F.coalesce("context", F.lit("")), F.coalesce("function", F.lit(""))), F.coalesce("callers", F.array().cast("array<string>"))), wanted)
        if not set(rule.scope) & {"message"}:
            ok &= F.col("context") != "message"
    hit = text.rlike("(?iu)" + rule.pattern) if rule.pattern else F.array_contains("marks", rule.id)
    return ok & hit & ~text.rlike("(?iu)" + rule.unless) if rule.unless else ok & hit


def findings(lines: DataFrame, id_column: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The first hit of each rule in each diff: id, rule_id, severity, category, idx, file, lineno, match.

    lines: as diff_lines gives them. One pass over the lines for all rules; partial aggregation keeps one hit per diff and rule.
    """
    if not rules:
        return lines.sparkSession.createDataFrame([], f"{lines.select(id_column).schema.simpleString()[7:-1]}, rule_id string, severity string, category string, idx int, file string, lineno int, match string")
    # A line is matched whole. In a long one runs of blanks count as one, which no pattern tells apart: to try each of a run's places costs its square.
    packed = lambda c: F.when(F.length(c) > LINE_CHARS, F.regexp_replace(c, "[ \t]{2,}", " ")).otherwise(F.col(c))
    lines = lines.withColumns({"_raw": packed("body"), "_resolved": packed("resolved")})
    special = _pipelines() if rules is RULES else []
    hits = F.filter(F.array(*(F.when(_applies(r), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))) for r in rules),
        *(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(k).alias("category"))) for i, s, k, c in special)), lambda h: h.isNotNull())
    rows = lines.select(id_column, "idx", "file", "lineno", F.coalesce("resolved", "body").alias("match"), F.explode(hits).alias("_h"))
    first = rows.groupBy(id_column, "_h.rule_id").agg(F.min(F.struct("idx", "_h.severity", "_h.category", "file", "lineno", "match")).alias("_m"))
    return first.select(id_column, "rule_id", "_m.severity", "_m.category", "_m.idx", "_m.file", "_m.lineno", "_m.match")


def _urls_of(side: str) -> Column:
    return F.transform(f"{side}_urls", lambda u: F.regexp_extract(u, "://([^/?#]+)", 1))




def structural(facts: DataFrame, id_column: str) -> DataFrame:
    """Findings over a diff as a whole: id, rule_id, severity, category, match."""
    same_urls = (F.size("added_urls") == 0) & (F.size("removed_urls") == 0)
    show = lambda c: F.array_join(c, " ")
    rules = [
        ("C001", "HIGH", "integrity", F.col("sums_changed") & same_urls & ~F.col("version_changed"), show("digests")),
        ("C002", "INFO", "integrity", F.col("sums_changed") & same_urls & F.col("version_changed"), show("digests")),
        ("C003", "INFO", "integrity", (F.size("added_urls") > 0) & (F.size("removed_urls") > 0) & ~F.col("version_changed"), show("added_urls")),
        ("C004", "CRITICAL", "integrity", F.col("sums_removed") & same_urls, F.lit("")),
        ("C005", "MEDIUM", "source", F.exists("added_urls", lambda u: u.rlike(r"(?i)\.(?:bin|exe|elf|so|dll|dylib|appimage|deb|rpm|apk|msi|jar|run)(?:[?#]|$)")), show("added_urls")),
        ("C006", "HIGH", "source", (F.size("removed_urls") > 0) & (F.size(F.array_except(_urls_of("added"), _urls_of("removed"))) > 0), show(F.array_except(_urls_of("added"), _urls_of("removed")))),
        ("C007", "CRITICAL", "fetch", F.col("computed_sources"), F.lit("source")),
        ("C008", "HIGH", "integrity", F.col("carriers_moved") & ~F.col("version_changed"), F.lit("")),
        ("C009", "INFO", "integrity", F.col("carriers_moved") & F.col("version_changed"), F.lit("")),
        ("R068", "INFO", "installer", F.col("hook_declared"), F.lit("install")),
        ("R076", "MEDIUM", "network", F.col("odd_version"), F.col("pkgver_after")),
        ("R079", "HIGH", "integrity", F.exists("added_urls", lambda u: u.rlike("#(?:tag|branch|commit)=") & F.exists("removed_urls", lambda v: (F.substring_index(u, "#", 1) == F.substring_index(v, "#", 1)) & v.contains("#commit="))) & ~F.col("version_changed"), show("added_urls")),
        ("R004", "HIGH", "integrity", F.col("sums_skipped"), F.lit("SKIP")),
        ("R005", "HIGH", "integrity", F.col("sums_emptied"), F.lit("()")),
        ("R006", "LOW", "network", F.exists("added_urls", lambda u: u.startswith("http://")) & ~F.col("sums_changed"), show("added_urls")),
        ("R060", "INFO", "build", F.arrays_overlap("functions_changed", F.array(*(F.lit(f) for f in BUILD_FUNCTIONS))), show("functions_changed")),
        ("R064", "MEDIUM", "network", F.exists("added_urls", lambda u: u.startswith("http://") & F.array_contains(F.col("removed_urls"), F.concat(F.lit("https"), F.substring(u, F.lit(5), F.length(u))))), show("added_urls")),
        ("R069", "HIGH", "integrity", (F.size("keys_removed") > 0) & (F.size("keys_added") == 0), show("keys_removed")),
        ("R080", "MEDIUM", "source", F.exists("added_urls", lambda u: ~u.rlike(r"(?i)^(?:(?:git|svn|hg|bzr)\+)?(?:https?|ftps?|git|ssh|file)://")), show("added_urls")),
        ("R115", "MEDIUM", "metadata", F.col("epoch_added"), F.lit("epoch")),
        ("R130", "HIGH", "integrity", F.size("keys_added") > 0, show("keys_added")),
        ("R142", "MEDIUM", "integrity", ((F.size("depends_added") > 0) | (F.size("makedepends_added") > 0)) & (F.size("functions_changed") > 0) & same_urls & ~F.col("sums_changed") & ~F.col("version_changed"), show("depends_added")),
        ("R147", "HIGH", "integrity", F.col("sums_short"), F.lit("")),
        ("D003", "MEDIUM", "dependency", F.arrays_overlap("makedepends_added", F.array(*(F.lit(x) for x in ("curl", "wget", "git", "aria2", "python-requests")))), show("makedepends_added")),
    ]
    hits = F.filter(
        F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(k).alias("category"), m.alias("match"))) for i, s, k, c, m in rules)), lambda h: h.isNotNull()
    )
    return facts.select(id_column, F.explode(hits).alias("_h")).select(id_column, "_h.*")
