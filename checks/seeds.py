"""Captures derived from ``pages`` and ``documents`` by SQL text that both
engines run.

Natural pages hold few disclosures, so every page gets one snippet per rule
family, picked by its id, and a few captures of well-known paths on its host.
Token-like samples are put together from pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators.paths import API, DIRECTORIES, GIT, SENSITIVE
from seepage.rules import dns as dns_rules
from seepage.rules import headers as header_rules
from seepage.rules import metadata as metadata_rules
from seepage.sources.readers import spread


def text(value: str) -> str:
    """SQL for a string without quotes, back-slashes or control characters in literals."""
    parts, plain = [], ""
    for char in value:
        if char in "'\\\n\r\t" or ord(char) > 126:
            if plain:
                parts.append(f"'{plain}'")
            parts.append(f"chr({ord(char)})")
            plain = ""
        else:
            plain += char
    if plain or not parts:
        parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def choose(key: str, values: list[str]) -> str:
    """CASE over ``key % len(values)`` with the values as text."""
    branches = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {branches} END)"


_HEX32 = "0123456789abcdef" * 2
_MIX40 = "aB3dE5fG7iJ9kL1mN0oP2qR4sT6uV8wXyZ/+q1W2"
_MIX24 = "a1B2c3D4e5F6g7H8i9J0k1L2"

SECRETS = [
    "AK" + "IA" + "IOSFODNN7Q2ZMPLE",
    "AK" + "IA" + "IOSFODNN7Q2ZMPL",
    "AK" + "IA" + "A" * 16,
    "k = '" + _MIX40 + "'",
    'k = "' + _MIX40 + '"',
    "AI" + "za" + _MIX40[:35].replace("/", "-").replace("+", "_"),
    "123456-" + _HEX32 + ".apps.googleusercontent.com",
    "https://demo-app-7x.firebaseio.com/data.json",
    "pk" + "_live_" + _MIX24,
    "sk" + "_live_" + _MIX24,
    "sk" + "_live_" + _MIX24[:20],
    "xo" + "xb-" + "12345-abcdeFGHIJ",
    "gh" + "p_" + _MIX40[:34] + "Q7",
    "gh" + "o_" + _MIX40[:34] + "Q7",
    "gl" + "pat-" + _MIX24,
    "token=ey" + "J" + _MIX24 + "." + _MIX24 + "." + _MIX24 + " ",
    "Authorization: Bearer " + _MIX24,
    "Authorization: basic " + _MIX24 + "==",
    "A" + "C" + _HEX32,
    "S" + "K" + _HEX32,
    "S" + "G." + "aB3dE5fG7iJ9kL1mN0oP2q" + "." + "aB3dE5fG7iJ9kL1mN0oP2qR4sT6uV8wXyZaB3dE5fG7",
    "pk" + ".ey" + "J" + _MIX24 + "." + _MIX24,
    "6" + "L" + _MIX40[:34] + "Q7b9",
    "https://" + _HEX32 + "@" + _HEX32 + ".ingest.sentry.io/42 ",
    "secret: " + _MIX40[:33] + " key=" + "d41d8cd98f00b204e9800998ecf8427e",
    "password='aaaaaaaaaaaaaaaaaaaaaaaa' and 'short1'",
    "nothing to see",
]

SOURCE = [
    "<!-- build 17: remove before release -->",
    "<!-- open and never closed",
    "// TODO: rotate the signing key. Later",
    "/* fixme handle this, hack */ debug BUGGY",
    "see http://staging.shop.corp/path?q=1 and https://stage-shop.corp/",
    'fetch("/api/v2/users/42"); x="/graphql?query=1"; "/rest/v1/items"; "/api/vX/none"',
    '<a href="/administrator/">a</a> <a href="/cpanel">c</a> /adminx',
    "mail ops@corp-internal.io or dev@example.com, root@@x",
    "call +49-30-1234-5678 or 555 1234",
    "hosts 10.1.2.3 and 8.8.8.8 and 192.168.001.1 and 300.1.1.1 and 172.31.9.9 and 192.0.0.9",
    "ssh dev-web01.corp and qa-db.example.com",
    "bucket my.assets.s3.amazonaws.com and s3://raw-data_1/x",
    "postgresql://svc:pw@db.local/app redis://cache mongodb:// nothing",
    "a@b.co a@b.co c@d.org" + " x%d@many.example.io" * 0,
    "\r\n  <!--  \t  -->  <!--ok-->",
    "many " + " ".join(f"u{i}@mail{i}.io" for i in range(24)),
    "plain words only",
]

ERRORS = [
    "Fatal error:  Uncaught Exception in  /var/www/app/index.php on line 42",
    "Warning: something odd happened in the kitchen",
    "#0 /srv/www/lib.php(120): handler->run()\n#1 {main}\n",
    'Traceback (most recent call last):\n  File "a.py", line 1, in <module>\n    f()\nValueError: bad',
    "Traceback (most recent call last):\n  no closing name here\n",
    "Django version 4.2 using settings\nPython executable: /usr/bin/python3",
    "Flask DebugToolbar is on; The debugger caught an exception",
    'Exception in thread "main": java.lang.IllegalStateException\n  at com.acme.App.run(App.java:17)',
    "oops\n    at com.acme.App.run(App.java:17)\n    at com.acme.Main.main(Main.java:3)\n",
    "Whitelabel Error Page\nThis application has no explicit mapping",
    "Server Error in '/' Application.",
    "[HttpException]: x  Stack Trace: <!-- Web.config Configuration File -->",
    "ASP.NET version: 4.0.30319 and ASP.NET version: 4",
    "TypeError: x is undefined\n    at render (/app/src/page.tsx:10:5)\n",
    "oops\n    at next (/app/node_modules/express/lib/router.js:12:9)\n",
    "Laravel 9.1 (PHP 8.1) Whoops ! There was an error",
    "Rails root: /srv/app  Application Trace",
    "NoMethodError in Foo\nundefined\n/srv/app/models/x.rb:10:in call",
    "panic: boom\n\ngoroutine 1 [running]:\nmain.go:12\n",
    "APP_DEBUG = true; debug: TRUE; debug=false",
    "failed in /var/www/site/a.php:12 and in C:\\inetpub/x.cs:9 and in /tmp/x.py:1",
    "Notice: a in b.php on line 1 Notice: c in d.php on line 2 Notice: e in f.php on line 3 Notice: g in h.php on line 4",
    "all good here",
]

CLOUD = [
    "https://my-bucket.s3.amazonaws.com/a/b.txt",
    "arn:aws:s3:::data-lake",
    'cfg = {"bucket": "raw-zone"}',
    "ec2-10-20-30-40.compute.amazonaws.com",
    "prod-db.rds.amazonaws.com x.rds.com",
    "front-123456.us-east.elb.amazonaws.com",
    "https://d111abc.cloudfront.net/img.png",
    "arn:aws:lambda:eu-west-1:123456789012:function:resize-img",
    "arn:aws:iam::123456789012:user/alice arn:aws:iam::123:role/ops",
    "https://acct1.blob.core.windows.net/c/x",
    "https://shop-app.azurewebsites.net/",
    "https://sql1.database.windows.net",
    "https://c1.redis.cache.windows.net",
    "https://e1.azureedge.net/x",
    "https://vm1.westeurope.azure.com",
    "https://storage.googleapis.com/bkt-1/o/x",
    "https://fn-x.cloudfunctions.net/run",
    "https://proj.appspot.com",
    "https://h1.us-central1.compute.amazonaws.com",
    '"projectId": "p-1", "datasetId"',
    "https://sp.ondigitalocean.com/x",
    "https://x-y.herokuapp.com",
    "https://fb-1.firebaseio.com/x HTTPS://FB-1.FIREBASEIO.COM/y",
    "https://fb-1.firebaseapp.com",
    '{"aws": 1, "gke" : 2, "rocks": 3}',
    "/subscriptions/0a1b2c3d-0a1b-2c3d-4e5f-0a1b2c3d4e5f/x /subscriptions/short/x",
    "/projects/my-project-1/locations /projects/abc/x",
    " ".join(f"arn:aws:s3:::bucket-{i}" for i in range(8)),
    "no cloud here",
]

# inline scripts and script files
SCRIPTS = [
    'const key = "' + "AK" + "IA" + 'IOSFODNN7Q2ZMPLE"; // prod',
    "fetch('http://localhost:8080/admin'); fetch('http://10.0.0.5/x'); fetch('https://8.8.8.8/')",
    'const u = "https://build.internal:8443/job"; const v = "https://build.example.org/";',
    "new WebSocket('wss://push.shop.io/feed')",
    "img('https://assets.s3.amazonaws.com/a.png'); img('https://assets.s3-eu-west-1.amazonaws.com/b.png')",
    "call('https://abc.execute-api.eu-west-1.amazonaws.com/prod')",
    "load('https://d1.cloudfront.net/x.js'); load('https://a.azurewebsites.net/x'); load('https://a.azureedge.net/y')",
    "run('https://fn.cloudfunctions.net/go'); get('https://storage.googleapis.com/b/o')",
    "gql('https://shop.graphql.acme.io/q'); rest('https://x.api.acme.io/v1')",
    "const a = process.env.DB_HOST, b = import.meta.env.VITE_KEY, c = __ENV__.stage;",
    'cfg = {"apiKey": "' + _MIX24 + '", "password": "aaaaaaaaaa", "token": "short"}',
    "cfg = {'private_key' = '" + _MIX40[:33] + "'}",
    'firebase({"projectId": "demo-1", "storageBucket": "demo-1.appspot.com", "appId": "1:23:web"})',
    "var h='" + "d41d8cd98f00b204e9800998ecf8427e" + "'; var t='ey" + "J" + _MIX24 + "." + _MIX24 + "." + _MIX24 + "';",
    "   ",
    "var nothing = 1;",
]

LISTINGS = [
    "",
    '<title>Index of /files</title><a href="?C=N;O=D">n</a><a href="a/">a</a><a href="b.txt">b</a>',
    '<h1>Directory Listing</h1>' + "".join(f'<a href="d{i}/x{i}">l</a>' for i in range(35)),
    "<a href='x/'>x</a>" + "".join(f"<a class=c href='dir{i}/'>d</a>" for i in range(7)) + '<a href="#top/">t</a>',
    "".join(f'<A HREF="dir{i}/">d</A>' for i in range(9)) + '<a href="javascript:void(0)/">j</a><a href="q.pdf">p</a>',
    "Parent Directory</a>",
    "index of /lower",
]

TECH = [
    '<meta name="generator" content="WordPress 6.1">/wp-content/themes/x /wp-includes/y',
    "Drupal.settings and joomla!", "cdn.shopify.com", "static.squarespace.com webflow", "magento prestashop modx",
    '<meta name="csrf-token" content="x">', "__VIEWSTATE", "ghost hubspot laravel", "wixstatic", "nothing",
    "<META NAME=generator CONTENT=Hugo>",
]

SERVERS = [
    "nginx/1.18.0 (Ubuntu)", "Apache/2.4.1", "Microsoft-IIS/10.0", "cloudflare", "gunicorn/20.1", "openresty/1.19",
    "Apache Tomcat", "uvicorn", " ", "Jetty(9.4)", "lighttpd/1.4 caddy",
]
POWERED_BY = ["PHP/8.1.2", "ASP.NET", "Express", "Django", "Go 1.20", "Phusion Passenger (Ruby on Rails)", "Node.js java"]
COOKIES = [
    "PHPSESSID", "JSESSIONID", "ASPSESSIONIDABC", "ASP.NET_SessionId", "laravel_session", "ci_session",
    "django_session", "flask_x", "_rails", "wordpress_logged_in", "wp-settings-1", "plain", "phpsessid",
]
STATUSES = ["200", "200", "201", "200", "301", "200", "403", "404", "500", "200", "202", "0"]

# what a probed path answers with, before the html
_PROBE_BODIES = {
    ".env": "APP=1\nDB_HOST=10.0.0.1\nNAME=x\nSECRET=abc\nEND=1",
    "config.php": "<?php\n$db_user = 'x';\n$passwd = 'y';",
    "config.json": '{"name": "x",\n"password": "y"}',
    "database.yml": "dev:\n  username: x\n  host: y",
    "application.properties": "server.port=1\nspring.datasource.url=jdbc:x",
    "web.config": "<configuration>\n<add connectionString='x'/>",
    ".htaccess": "AuthType Basic\nRequire valid-user",
    ".htpasswd": "admin:$apr1$x$y",
    ".git/config": "[core]\n\trepositoryformatversion = 0\n[remote \"origin\"]\n\turl = git@x:y.git\nplain",
    ".git/HEAD": "ref: refs/heads/main\n",
    ".git/refs/heads/main": "0123456789abcdef0123456789abcdef01234567\n",
    ".svn/entries": "10\nsvn://x",
    "robots.txt": "User-agent: *\nDisallow: /x",
    "sitemap.xml": "<urlset>\n<url><loc>x</loc></url>",
    "security.txt": "Contact: mailto:x",
    "server-status": "Apache Server Status for x\nTotal Accesses: 1",
    "composer.lock": '{"packages": []}',
    "package-lock.json": '{"name": "x",\n "dependencies": {}}',
    "debug.log": "ok\n[error] x\nok\nok\nok\nok\nwarning y\nok",
    "error.log": "fine\nFATAL x",
    "swagger.json": '{\n"swagger": "2.0", "host": "x"}',
    "openapi.json": '{"openapi": "3.0.0"}',
    "swagger.yaml": "swagger: 2",
    "api/docs": '<div id="swagger-ui"></div>\n<script>SwaggerUIBundle({})</script>',
    "swagger": "SwaggerUIBundle",
    "graphql": "query Users { id }",
    "graphql/playground": '<title>GraphQL Playground</title>',
    "graphiql": "<div>graphiql</div>",
    "api/graphql": '{"data": {"__schema": {}}}',
    "redoc": "a\nb\nc\n<redoc></redoc>\nd\ne\nf",
    "v2/api-docs": '{"info": {"title": "x", "version": "1"}}',
    "v3/api-docs": '{"paths" : {}}',
    "backup/": "<h1>Index of /backup</h1><a href='x.zip'>x</a>",
    ".git/": "Index of /.git HEAD config",
}

PROBED_PATHS = [*SENSITIVE, *[p for p in GIT if p not in SENSITIVE], *[p for p in API if p not in SENSITIVE], *DIRECTORIES]


def _header_names(offset: int, names: list[str]) -> str:
    return f"(CASE WHEN page_id % 4 = 0 THEN lower({choose(f'page_id + {offset}', names)}) ELSE {choose(f'page_id + {offset}', names)} END)"


_TARGET = "regexp_extract(url, '^https?://[^/?#]+', 0)"
# Server and X-Powered-By have columns of their own
_DISCLOSURE = [n for n, _, _ in header_rules.DISCLOSURE if n not in ("Server", "X-Powered-By")]


def captures_sql(pages: str = "pages") -> str:
    """target, url, status, body, header and cookie scalars, fetched_s."""
    script_tag = (
        "'<script src=' || chr(34) || CASE page_id % 4"
        f" WHEN 0 THEN '/static/app' || CAST(page_id % 5 AS STRING) || '.js'"
        f" WHEN 1 THEN {_TARGET} || '/static/app' || CAST(page_id % 5 AS STRING) || '.bundle.js'"
        f" WHEN 2 THEN regexp_extract({_TARGET}, '//.*$', 0) || '/static/app' || CAST(page_id % 5 AS STRING) || '.js'"
        f" ELSE 'static/app' || CAST(page_id % 5 AS STRING) || '.min.js' END"
        " || chr(34) || '></script>'"
    )
    page_body = (
        "CASE WHEN page_id % 29 = 28 THEN NULL WHEN page_id % 29 = 27 THEN '' ELSE html"
        f" || chr(10) || {choose('page_id', SOURCE)}"
        f" || chr(10) || {choose('page_id', SECRETS)}"
        f" || chr(10) || {choose('page_id', ERRORS)}"
        f" || chr(10) || {choose('page_id', CLOUD)}"
        f" || chr(10) || {choose('page_id', LISTINGS)}"
        f" || chr(10) || {choose('page_id', TECH)}"
        f" || chr(10) || '<script>' || {choose('page_id', SCRIPTS)} || '</script>'"
        f" || chr(10) || {script_tag} END"
    )
    listed = ", ".join(text(p) for p in PROBED_PATHS)
    bodies = " ".join(f"WHEN {text(p)} THEN {text(b)}" for p, b in _PROBE_BODIES.items())
    return f"""
SELECT 'page' AS source, page_id, {_TARGET} AS target, url,
  CAST({choose('page_id', STATUSES)} AS INT) AS status,
  {page_body} AS body,
  {choose('page_id', SERVERS)} AS h_server,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE {choose('page_id', POWERED_BY)} END AS h_powered_by,
  {_header_names(0, _DISCLOSURE)} AS h1_name,
  CASE WHEN page_id % 7 = 3 THEN ' ' ELSE 'v' || CAST(page_id AS STRING) END AS h1_value,
  {_header_names(5, header_rules.INFRASTRUCTURE)} AS h2_name,
  CASE WHEN page_id % 7 = 4 THEN '' ELSE 'node-' || CAST(page_id % 6 AS STRING) END AS h2_value,
  {choose('page_id', COOKIES)} AS cookie_name,
  1704067200 + page_id AS fetched_s
FROM {pages}
UNION ALL
SELECT 'probe', page_id, target, target || '/' || path,
  CASE page_id % 7 WHEN 3 THEN 404 WHEN 5 THEN 301 ELSE 200 END,
  CASE WHEN page_id % 5 = 4 THEN html
    WHEN page_id % 2 = 0 THEN snippet ELSE snippet || chr(10) || html END,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1704067200 + page_id
FROM (
  SELECT page_id, html, target, path, CASE path {bodies} ELSE 'content of ' || path END AS snippet
  FROM (
    SELECT page_id, html, {_TARGET} AS target,
      {_list_item(listed, f"CAST((page_id * 4 + j) % {len(PROBED_PATHS)} AS INT)")} AS path
    FROM (SELECT page_id, url, html, EACH_OF(0, 1, 2, 3) AS j FROM {pages}) AS repeated
  ) AS probed
) AS answered
UNION ALL
SELECT 'script', page_id, {_TARGET},
  {_TARGET} || '/static/app' || CAST(page_id % 5 AS STRING) || {choose('page_id', ['.js', '.bundle.js', '.min.js'])},
  CASE page_id % 9 WHEN 8 THEN 404 ELSE 200 END,
  'var page = ' || CAST(page_id AS STRING) || ';' || chr(10) || {choose('page_id + 1', SCRIPTS)}
    || chr(10) || {choose('page_id + 3', SECRETS)},
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1704067200 + page_id
FROM {pages}
"""


def _list_item(listed: str, index: str) -> str:
    # both engines count list elements from 1 in element_at
    return f"element_at(ARRAY_OF({listed}), {index} + 1)"


def dns_sql(pages: str = "pages") -> str:
    """hostname, rtype, value: one record per page and an address per host."""
    host = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
    ip = choose("page_id", ["10.0.0.7", "93.184.216.34", "192.168.7.7", "172.20.1.1", "8.8.4.4", "010.1.1.1", "127.0.0.1"])
    txt = choose("page_id", [
        "v=spf1 include:mail.internal.corp include:spf.example.org ~all",
        "v=DKIM1; s=selector1; p=abc", "v=DMARC1; p=none; sp=reject", "v=DMARC1; p=quarantine; sp=none",
        "v=DMARC1; p=reject", "host.10.1.2.3", "x.dev.corp.jenkins.example", "192.168.1.9.x 10.0.0.1", "plain text",
        "v=spf1 a:x ~all", "V=SPF1 include:dev-mail.corp -all redirect=x",
    ])
    mx = choose("page_id", ["10 mx.example.org", "10 mx-dev.example.org", "20 localmail.x", " 5 Stage.mx "])
    cname = choose("page_id", ["www.example.org", "qa.example.org", "Staging.cdn.example.org"])
    label = choose("page_id", [*dns_rules.SUBDOMAINS, "www", "shop"])
    return f"""
SELECT page_id, hostname, rtype, value FROM (
  SELECT page_id, {host} AS hostname, 'TXT' AS rtype, {txt} AS value FROM {pages}
  UNION ALL SELECT page_id, {host}, 'MX', {mx} FROM {pages} WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, {host}, 'CNAME', {cname} FROM {pages} WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, {host}, 'A', {ip} FROM {pages} WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, {label} || '.' || {host}, 'A', {choose("page_id + 1", ["10.0.0.7", "93.184.216.34", "192.168.7.7"])} FROM {pages}
  UNION ALL SELECT page_id, {ip}, 'PTR', {choose("page_id", ["web.example.org", "QA-7.example.org", "x.internal"])} FROM {pages}
) AS records
"""


def target_lines_sql(pages: str = "pages") -> str:
    """value: the lines of a target list, with everything that can go wrong."""
    return f"""
SELECT CASE page_id % 7 WHEN 0 THEN '  ' || url || '/// ' WHEN 1 THEN '# ' || url WHEN 2 THEN ' '
  WHEN 3 THEN 'host' || CAST(page_id AS STRING) || '.example.org/' WHEN 4 THEN 'https:///nohost' || CAST(page_id AS STRING)
  WHEN 5 THEN chr(9) || {_TARGET} || chr(13) ELSE url END AS value
FROM {pages}
"""


def documents_sql(documents: str = "documents") -> str:
    """target, url, status, content_type, content (text), xml: captured files."""
    path = choose("doc_id", metadata_rules.PATHS + ["notes.txt", "a.doc", "x.PDF"])
    dictionary = choose("doc_id", [
        "%PDF-1.4 /Author (Jane Roe) /Creator(Writer) /Producer (Lib 1.2) /CreationDate (D:2024)",
        "%PDF-1.4 /Title (Plan) /Subject () /ModDate (D:2024)",
        "%PDF-1.4 /author (unknown) mail a.b@corp.io, x@example.com, a.b@corp.io at /home/jane/x.txt /etc/app.conf",
        "Author: 'John Doe'\nCreator - \"Tool\"\nauthor: Unknown\nAuthor: fourth",
        "%PDF-1.4 no info", "/usr/local/bin/x /var/log/y /opt/z.py",
    ])
    xml = choose("doc_id", [
        "<cp><dc:creator>Jane Roe</dc:creator><cp:lastModifiedBy>Bob</cp:lastModifiedBy><dcterms:created a=1>2024</dcterms:created></cp>",
        "<cp><dcterms:modified>2023</dcterms:modified><cp:revision>7</cp:revision></cp>",
        "<cp></cp>",
        "<cp><dc:creator></dc:creator><cp:revision>1</cp:revision></cp>",
    ])
    return f"""
SELECT doc_id, 'https://' || source || '.example.com' AS target,
  'https://' || source || '.example.com/' || {path} AS url,
  CASE doc_id % 11 WHEN 10 THEN 404 ELSE 200 END AS status,
  {choose("doc_id", ["", "application/pdf", "text/plain", "application/vnd.OpenXMLformats", "image/png"])} AS content_type,
  {dictionary} || chr(10) || text AS content,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE {xml} END AS xml
FROM {documents}
"""


def for_duckdb(sql: str) -> str:
    sql = sql.replace("element_at(ARRAY_OF(", "list_extract(list_value(")
    return sql.replace("EACH_OF(0, 1, 2, 3)", "unnest([0, 1, 2, 3])")


def _spark(spark: SparkSession, sql: str) -> DataFrame:
    sql = sql.replace("ARRAY_OF(", "array(")
    return spark.sql(sql.replace("EACH_OF(0, 1, 2, 3)", "explode(array(0, 1, 2, 3))"))


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A view of the table with a partition per core."""
    spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")).createOrReplaceTempView(f"spread_{name}")
    return f"spread_{name}"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spark(spark, captures_sql(_view(spark, sf_dir, "pages")))
    entries = F.array(*[
        F.struct(name.alias("key"), F.col(value).alias("value"))
        for name, value in (
            (F.lit("Server"), "h_server"), (F.lit("x-powered-by"), "h_powered_by"),
            (F.col("h1_name"), "h1_value"), (F.col("h2_name"), "h2_value"))
    ])
    return rows.select(
        "target", "url", "status", "body",
        F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())).alias("headers"),
        F.when(F.col("cookie_name").isNotNull(), F.create_map("cookie_name", F.lit("1"))).alias("cookies"),
        F.timestamp_seconds("fetched_s").alias("fetched_at"),
    )


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, dns_sql(_table(sf_dir, "pages"))).select("hostname", "rtype", "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, documents_sql(_view(spark, sf_dir, "documents"))).select(
        "doc_id", "target", "url", "status", "content_type",
        F.col("content").cast("binary").alias("body_bytes"), "xml",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("fetched_at"))
