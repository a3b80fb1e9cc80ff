"""Queries that meet every branch of the rules for source text and server configuration.

Each order writes one line, in the shape that its key selects. A shape is the line and the facts to expect of it, all as
SQL expressions of k, the order's key; the corpus and the SQL twin of a query come from the same list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import backend, serverconfig
from factweave.plans.catalogue import query, table

Shape = tuple[str, list[tuple[str, ...]]]
SOURCE: dict[str, tuple[str, list[str], list[Shape]]] = {
    "handlers": ("B1 V10", ["handler", "kind"], [
        ("""'websUrlHandlerDefine("/u' || (k % 9) || '", onU' || (k % 9) || ');'""", [("'onU' || (k % 9)", "'registration'")]),
        ("""'register_handler("r' || (k % 9) || '", onR' || (k % 9) || ');'""", [("'onR' || (k % 9)", "'registration'")]),
        ("""'cgi_register("c' || (k % 9) || '", onC' || (k % 9) || ');'""", [("'onC' || (k % 9)", "'registration'")]),
        ("""'  { "d' || (k % 9) || '", onD' || (k % 9) || ' },'""", [("'onD' || (k % 9)", "'dispatch_table'")]),
        ("'void show' || (k % 9) || '_asp(int n)'", [("'show' || (k % 9) || '_asp'", "'handler_symbol'")]),
        ("'char * read' || (k % 9) || '_form(int n)'", [("'read' || (k % 9) || '_form'", "'handler_symbol'")]),
    ]),
    "routes": ("B2 V11", ["route", "kind", "dispatch_key"], [
        ("""'x = "/goform/set' || (k % 50) || '";'""", [("'/goform/set' || (k % 50)", "'url_literal'", "NULL")]),
        ("""'x = "/cgi-bin/run' || (k % 50) || '";'""", [("'/cgi-bin/run' || (k % 50)", "'url_literal'", "NULL")]),
        ("""'x = "page' || (k % 50) || '.asp?x=1";'""", [("'page' || (k % 50) || '.asp?x=1'", "'cgi_asp_stm_literal'", "NULL")]),
        ("""'add("action", "save' || (k % 50) || '");'""", [("'save' || (k % 50)", "'dispatch_key_value'", "'action'")]),
        ("""'"cmd" = "reset' || (k % 50) || '"'""", [("'reset' || (k % 50)", "'dispatch_key_value'", "'cmd'")]),
        ("""'puts("Location: /next' || (k % 50) || '.html");'""", [("'/next' || (k % 50) || '.html'", "'location_header'", "NULL")]),
        ("""'cgi_register("save' || (k % 50) || '", onSave);'""", [("'save' || (k % 50)", "'handler_linked'", "NULL")]),
    ]),
    "params": ("B3 T15 Q36 Q37", ["param", "read_api", "param_source", "default_value"], [
        ("""'v = cgiFormString(a, "name' || (k % 40) || '", buf);'""", [("'name' || (k % 40)", "'cgiFormString'", "'body'", "'buf'")]),
        ("""'v = websGetVar2(wp, "w' || (k % 40) || '");'""", [("'w' || (k % 40)", "'websGetVar2'", "'unknown'", "NULL")]),
        ("""'v = get_cgi("key' || (k % 40) || '", "d");'""", [("'key' || (k % 40)", "'get_cgi'", "'unknown'", """'"d"'""")]),
        ("""'v' || (k % 7) || ' = getenv("HTTP_COOKIE");'""", [("'HTTP_COOKIE'", "'getenv'", "'cookie'", "NULL")]),
        ("""'v' || (k % 7) || ' = getenv("QUERY_STRING");'""", [("'QUERY_STRING'", "'getenv'", "'env'", "NULL")]),
        ("""'v = read_header_value("X-Id' || (k % 40) || '");'""", [("'X-Id' || (k % 40)", "'read_header_value'", "'header'", "NULL")]),
        ("""'v = my_query_of("q' || (k % 40) || '");'""", [("'q' || (k % 40)", "'my_query_of'", "'query'", "NULL")]),
    ]),
    "constraints": ("B4 V13", ["constraint_type", "api", "target", "operator", "value", "extra"], [
        ("'n = strtol(v' || (k % 9) || ', 0, 10);'", [("'int_cast'", "'strtol'", "'v' || (k % 9)", "NULL", "NULL", "NULL")]),
        ("'if (strlen(v' || (k % 9) || ') >= 8) f();'", [("'strlen_compare'", "NULL", "'v' || (k % 9)", "'>='", "'8'", "NULL")]),
        ("""'if (strcasecmp(v' || (k % 9) || ', "on") == 0) f();'""", [("'string_enum'", "'strcasecmp'", "'v' || (k % 9)", "NULL", "'on'", "NULL")]),
        ("""'strncmp(v' || (k % 9) || ', "ab", 2);'""", [("'string_enum'", "'strncmp'", "'v' || (k % 9)", "NULL", "'ab'", "'2'")]),
        ("""'sscanf(v' || (k % 9) || ', "%d", n);'""", [("'format_scan'", "NULL", "'v' || (k % 9)", "NULL", "'%d'", "NULL")]),
        ("'a = inet_addr(v' || (k % 9) || ');'", [("'ip_format'", "'inet_addr'", "'v' || (k % 9)", "NULL", "NULL", "NULL")]),
        ("'if (!v' || (k % 9) || ') return;'", [("'null_or_empty'", "NULL", "NULL", "NULL", "NULL", "'!v' || (k % 9)")]),
        ("'if (v' || (k % 9) || ' == NULL) return;'", [("'null_or_empty'", "NULL", "NULL", "NULL", "NULL", "'v' || (k % 9) || ' == NULL'")]),
        ("'if (v' || (k % 9) || ' != -1) return;'", [("'numeric_boundary'", "NULL", "'v' || (k % 9)", "'!='", "'-1'", "NULL")]),
    ]),
    "sinks": ("B6 V16 Q19", ["sink_category", "api"], [
        ("'popen(c' || (k % 9) || ');'", [("'command'", "'popen'")]), ("'fopen(p' || (k % 9) || ');'", [("'file'", "'fopen'")]), ("'chmod(p' || (k % 9) || ');'", [("'file'", "'chmod'")]),
        ("'strcpy(a, b' || (k % 9) || ');'", [("'memory'", "'strcpy'")]), ("'send(s, b' || (k % 9) || ');'", [("'network'", "'send'")]), ("'nvram_commit(n' || (k % 9) || ');'", [("'config_state'", "'nvram_commit'")]),
        ("'mib_set(n' || (k % 9) || ');'", [("'config_state'", "'mib_set'")]), ("'upgrade_now(n' || (k % 9) || ');'", [("'state'", "'upgrade'")]),
    ]),
}
CONFIG: dict[str, tuple[str, list[str], list[Shape]]] = {
    "servers": ("C1 A8 Q35", ["type", "confidence"], [
        ("'exec busybox httpd -p ' || (k % 9)", [("'busybox httpd'", "'medium'"), ("'httpd'", "'medium'")]), ("'goahead --home /e' || (k % 9)", [("'goahead'", "'medium'")]), ("'server.port = ' || (k % 9)", [("'lighttpd'", "'medium'")]),
        ("'mini_httpd -d /w' || (k % 9)", [("'httpd'", "'medium'")]), ("'CGIPath /b' || (k % 9)", [("'boa'", "'medium'")]), ("'server {'", [("'nginx'", "'medium'")]),
    ]),
    "listeners": ("C2 T18 T19 A9", ["address", "port", "protocol"], [
        ("'server.port = 80' || (k % 10)", [("NULL", "800 + k % 10", "'http'")]), ("'HTTP_PORT = 70' || (k % 10)", [("NULL", "700 + k % 10", "'http'")]), ("'Listen 10.0.0.1:81' || (k % 10)", [("'10.0.0.1'", "810 + k % 10", "'http'")]),
        ("'listen 90' || (k % 10) || ' ssl;'", [("NULL", "900 + k % 10", "'https'")]), ("'httpd -p 60' || (k % 10)", [("NULL", "600 + k % 10", "'http'")]),
    ]),
    "document_roots": ("C3", ["root_type", "path"], [
        ("'ServerRoot /srv' || (k % 9)", [("'server_root'", "'/srv' || (k % 9)")]), ("""'server.document-root = "/w' || (k % 9) || '"'""", [("'document_root'", "'/w' || (k % 9)")]), ("'root /r' || (k % 9) || ';'", [("'document_root'", "'/r' || (k % 9)")]),
        ("'WWWROOT=/v' || (k % 9)", [("'document_root'", "'/v' || (k % 9)")]), ("'httpd -h /h' || (k % 9)", [("'document_root'", "'/h' || (k % 9)")]),
    ]),
    "aliases": ("C4", ["url_prefix", "filesystem_path", "mapping_type"], [
        ("""'alias.url += ( "/a' || (k % 9) || '" => "/srv/a' || (k % 9) || '" )'""", [("'/a' || (k % 9)", "'/srv/a' || (k % 9)", "'alias'")]), ("'alias /only' || (k % 9) || ';'", [("NULL", "'/only' || (k % 9)", "'alias'")]),
    ]),
    "cgi_mappings": ("C5 Q14", ["mapping_type", "url_prefix", "filesystem_path", "handler", "extension"], [
        ("'ScriptAlias /s' || (k % 9) || '/ /srv/s'", [("'script_alias'", "'/s' || (k % 9) || '/'", "'/srv/s'", "NULL", "NULL")]),
        ("'ScriptAliasMatch ^/x' || (k % 9) || ' /srv/x'", [("'script_alias_match'", "'^/x' || (k % 9)", "'/srv/x'", "NULL", "NULL")]),
        ("'CGIPath /usr/p' || (k % 9)", [("'cgi_path'", "'/usr/p' || (k % 9)", "NULL", "NULL", "NULL")]),
        ("'AddHandler script-h' || (k % 9) || ' .pl'", [("'add_handler'", "NULL", "NULL", "'.pl'", "NULL")]),
        ("'AddType .php' || (k % 9) || ' app/x'", [("'add_type'", "NULL", "NULL", "'app/x'", "'.php' || (k % 9)")]),
        ("""'cgi.assign = ( "/as' || (k % 9) || '" => "/usr/bin/perl" )'""", [("'cgi_assign'", "'/as' || (k % 9)", "NULL", "'/usr/bin/perl'", "NULL")]),
        ("""'fastcgi.server = ( "/f' || (k % 9) || '"'""", [("'fastcgi'", "'/f' || (k % 9)", "NULL", "NULL", "NULL")]),
        ("'location /mycgi' || (k % 9) || ' {'", [("'location_cgi'", "'/mycgi' || (k % 9)", "NULL", "NULL", "NULL")]),
        ("'exec /opt/cgi-bin/ run' || (k % 9)", [("'cgi_bin'", "'/opt/cgi-bin/'", "'run' || (k % 9)", "NULL", "NULL")]),
        ("'match *.cgi files' || (k % 9)", [("'cgi_extension'", "NULL", "NULL", "NULL", "'*.cgi'")]),
    ]),
    "auth_rules": ("C6", ["rule_type", "value"], [
        ("'AuthType Basic' || (k % 9)", [("'auth_type'", "'Basic' || (k % 9)")]), ("'AuthName Zone' || (k % 9)", [("'realm'", "'Zone' || (k % 9)")]), ("'userfile /u' || (k % 9)", [("'password_file'", "'/u' || (k % 9)")]),
        ("""'auth.backend.htpasswd.userfile = "/h' || (k % 9) || '"'""", [("'password_file'", "'/h' || (k % 9)"), ("'htpasswd'", "'auth.backend.htpasswd.userfile'")]), ("""'auth.require = ( "/p' || (k % 9) || '" )'""", [("'auth_require'", """'( "/p' || (k % 9) || '" )'""")]),
        ("'Require user' || (k % 9)", [("'require'", "'user' || (k % 9)")]), ("'allow 10.0.0.' || (k % 9)", [("'allow'", "'10.0.0.' || (k % 9)")]), ("'deny all' || (k % 9)", [("'deny'", "'all' || (k % 9)")]),
        ("'Satisfy any' || (k % 9)", [("'satisfy'", "'any' || (k % 9)")]), ("'file /x/.htpasswd' || (k % 9)", [("'htpasswd'", "'/x/.htpasswd' || (k % 9)")]),
    ]),
    "startup_commands": ("C7 V29 V30", ["command", "config_path", "document_root", "port", "error_log", "auth_realm"], [
        ("'busybox httpd -p 80 -h /w' || (k % 9) || ' -r zone' || (k % 9)", [("'busybox httpd'", "NULL", "'/w' || (k % 9)", "'80'", "NULL", "'zone' || (k % 9)")]),
        ("'/usr/sbin/boa -c /etc/boa' || (k % 9) || ' -E /log' || (k % 9)", [("'boa'", "'/etc/boa' || (k % 9)", "NULL", "NULL", "'/log' || (k % 9)", "NULL")]),
        ("'goahead -h/g' || (k % 9)", [("'goahead'", "NULL", "'/g' || (k % 9)", "NULL", "NULL", "NULL")]), ("'nginx -f /n' || (k % 9)", [("'nginx'", "'/n' || (k % 9)", "NULL", "NULL", "NULL", "NULL")]),
    ]),
    "config_references": ("C8", ["reference_type", "path"], [
        ("""'include_shell "cat /e' || (k % 9) || '"'""", [("'include'", "'cat /e' || (k % 9)")]), ("'IncludeOptional /o' || (k % 9)", [("'include'", "'/o' || (k % 9)")]), ("'source /s' || (k % 9)", [("'source'", "'/s' || (k % 9)")]),
        ("'. /d' || (k % 9)", [("'source'", "'/d' || (k % 9)")]), ("'httpd -c /c' || (k % 9)", [("'command_option'", "'/c' || (k % 9)")]),
    ]),
}


def written_lines(spark: SparkSession, sf_dir: str, shapes: list[Shape]) -> DataFrame:
    """k and content: the line of each order."""
    k = F.col("k") % len(shapes)
    line = F.lit(None).cast("string")
    for number, (text, _) in enumerate(shapes):
        line = F.when(k == number, F.expr(text)).otherwise(line)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("content", line)


def expected(columns: list[str], shapes: list[Shape]) -> str:
    """The facts of the shapes as SQL over orders."""
    rows = [(number, fact) for number, (_, facts) in enumerate(shapes) for fact in facts]
    kinds = {"port": "INTEGER"} if "address" in columns else {}
    of = lambda fact: ", ".join(f"CAST({value} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c, value in zip(columns, fact, strict=True))
    return " UNION ALL ".join(f"SELECT o_orderkey AS k, {of(fact).replace('k %', 'o_orderkey %')} FROM orders WHERE o_orderkey % {len(shapes)} = {number}" for number, fact in rows)


def _register(family: str, name: str, operators: str, columns: list[str], shapes: list[Shape]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = written_lines(spark, sf_dir, shapes)
        if family == "src":
            found = backend.facts(lines.select(F.col("k").alias("source_file"), "content"), name).withColumnRenamed("source_file", "k")
        else:
            found = serverconfig.TABLES[name](lines.select(F.col("k").alias("bundle_id"), F.lit("a.conf").alias("source_file"), "content")).withColumnRenamed("bundle_id", "k")
        return found.select("k", *columns)

    run.__doc__ = f"Fact table {name} of lines derived from orders that meet each branch of its rules."
    run.__name__ = f"{family}_{name}_shapes"
    query(operators, expected(columns, shapes))(run)


for _family, _tables in (("src", SOURCE), ("cfg", CONFIG)):
    for _name, _entry in _tables.items():
        _register(_family, _name, *_entry)
