"""Technology fingerprints: (pattern, technology), matched without case."""

# Server header.
SERVER = [
    (r"nginx/([\d.]+)", "Nginx"), (r"apache(?:/([\d.]+))?", "Apache"), (r"iis/([\d.]+)", "IIS"),
    (r"openresty/([\d.]+)", "OpenResty"), (r"cloudflare", "Cloudflare"), (r"awselb", "AWS ELB"),
    (r"gunicorn", "Gunicorn"), (r"uvicorn", "Uvicorn"), (r"waitress", "Waitress"), (r"caddy", "Caddy"),
    (r"lighttpd", "Lighttpd"), (r"tomcat", "Tomcat"), (r"jetty", "Jetty"), (r"wildfly", "WildFly"),
    (r"jboss", "JBoss"), (r"weblogic", "WebLogic"), (r"websphere", "WebSphere"),
]

# X-Powered-By header.
POWERED_BY = [
    (r"php/([\d.]+)", "PHP"), (r"asp\.net", "ASP.NET"), (r"express", "Express"), (r"django", "Django"),
    (r"flask", "Flask"), (r"rails", "Rails"), (r"laravel", "Laravel"), (r"symfony", "Symfony"),
    (r"cakephp", "CakePHP"), (r"codeigniter", "CodeIgniter"), (r"yii", "Yii"), (r"node\.?js", "Node.js"),
    (r"python", "Python"), (r"java", "Java"), (r"ruby", "Ruby"), (r"go", "Go"),
]

# Page source.
HTML = [
    (r"<meta[^>]+name=\"?generator\"?[^>]+content=\"?([^\">]+)", "CMS Generator"),
    (r"wp-content", "WordPress"), (r"wp-includes", "WordPress"), (r"joomla", "Joomla"), (r"drupal", "Drupal"),
    (r"magento", "Magento"), (r"shopify", "Shopify"), (r"prestashop", "PrestaShop"), (r"modx", "MODX"),
    (r"wix", "Wix"), (r"squarespace", "Squarespace"), (r"webflow", "Webflow"), (r"ghost", "Ghost"),
    (r"hubspot", "HubSpot"), (r"laravel", "Laravel"), (r"csrf-token", "CSRF Protection"),
    (r"__VIEWSTATE", "ASP.NET ViewState"),
]

# Cookie names.
COOKIES = [
    (r"PHPSESSID", "PHP"), (r"JSESSIONID", "Java/J2EE"), (r"ASPSESSIONID", "ASP"),
    (r"ASP\.NET_SessionId", "ASP.NET"), (r"laravel_session", "Laravel"), (r"ci_session", "CodeIgniter"),
    (r"django_session", "Django"), (r"flask", "Flask"), (r"rails", "Rails"), (r"wordpress", "WordPress"),
    (r"wp-settings", "WordPress"),
]

# Headers reported verbatim.
INFRASTRUCTURE = [
    "X-AspNet-Version", "X-AspNetMvc-Version", "X-Drupal-Cache", "X-Drupal-Dynamic-Cache",
    "X-Drupal-Route", "X-Varnish", "X-Cache", "X-Cache-Hit", "CF-Ray", "CF-Cache-Status",
]
