"""Word lists and suffixes that decide what counts as which fact."""

FRONTEND_SUFFIXES = ["html", "htm", "asp", "stm", "shtml", "php"]
STATIC_SUFFIXES = ["css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "map"]
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
CONFIDENCES = ["low", "medium", "high"]
#: keyword -> kind; the first keyword that occurs wins.
AUTH_WORDS = {"auth": "auth", "csrf": "csrf", "login": "login", "logout": "logout", "nonce": "nonce", "passwd": "password", "password": "password", "session": "session", "sid": "session", "token": "token", "cookie": "cookie"}
STATE_WORDS = {"apply": "apply", "commit": "save", "reboot": "reboot", "reset": "reset", "restart": "restart", "restore": "restore", "save": "save", "upgrade": "upgrade"}
#: Parts of the names of hidden fields that guard a form.
SECRET_WORDS = ["token", "csrf", "nonce"]
OBJECT_KEYS = ["url", "uri", "action", "endpoint", "method", "type", "data", "params", "payload"]
#: Name parts that tell a field's type, in this order.
NAME_TYPES = [(["ip", "addr"], "ipv4_or_host"), (["port", "mtu", "vlan", "channel", "timeout", "interval"], "int"), (["mac"], "mac"), (["enable", "disable", "onoff", "switch"], "bool_or_enum")]
MUTATING_WORDS = ["apply", "save", "reboot", "reset", "delete", "remove", "update", "upgrade", "submit", "connect", "disconnect", "restore", "wps", "clone"]
SAFE_INPUT_TYPES = ["hidden", "text", "search", "select-one", "radio", "checkbox"]
STRING_AUTH_WORDS = ["login", "logout", "password", "passwd", "session", "auth", "cookie", "token", "nonce", "admin"]
STRING_STATE_WORDS = ["apply", "save", "reboot", "restart", "reset", "restore", "upgrade", "commit"]
STRING_RESPONSE_WORDS = ["success", "fail", "error", "invalid", "warning", "login", "logout", "reboot", "upgrade", "session"]
SINKS = {
    "command": ["system", "popen", "execl", "execv", "execve", "execvp", "dosystem"],
    "memory": ["strcpy", "strncpy", "strcat", "strncat", "sprintf", "snprintf", "vsprintf", "memcpy", "memmove", "gets"],
    "file": ["fopen", "open", "unlink", "remove", "rename", "chmod", "chown"],
    "config": ["nvram_set", "nvram_commit", "uci_set", "uci_commit", "apmib_set", "mib_set"],
    "state": ["reboot", "restart", "kill"],
    "network": ["socket", "connect", "send", "sendto", "recv"],
}
PARAM_READERS = ["websGetVar", "websGetVar2", "cgiFormString", "cgiFormInteger", "cgiFormDouble", "get_cgi", "getVar", "get_single", "GetValue", "getenv"]
CONFIG_APIS = [
    "nvram_get", "nvram_safe_get", "nvram_set", "nvram_unset", "nvram_commit", "nvram_default_get", "uci_get", "uci_set", "uci_commit", "apmib_get", "apmib_set", "mib_get", "mib_set", "config_get", "config_set",
]
SNIPPET_TOKENS = ["GetVar", "get_cgi", "nvram_", "uci_", "apmib_", "login", "apply", "reboot", "upgrade"]
#: One fixed order; a line that names two servers counts for the first.
SERVER_COMMANDS = ["httpd", "boa", "goahead", "lighttpd", "nginx"]
BINARY_IGNORED = ["i64", "id0", "id1", "id2", "nam", "til", "json", "md", "txt", "py", "cfg", "conf", "ini", "xml", "html", "htm", "js", "css", "csv", "log"]
BINARY_RUNNABLE = ["none", "o", "so", "elf", "bin", "cgi", "asp", "exe", "dll"]
