"""Response headers that disclose software or infrastructure."""

MODULE = "http_header"

# Header, description, rule severity.
DISCLOSURE = [
    ("Server", "Web server software and version disclosed", "Medium"),
    ("X-Powered-By", "Technology stack information disclosed", "Medium"),
    ("X-AspNet-Version", "ASP.NET framework version disclosed", "High"),
    ("X-AspNetMvc-Version", "ASP.NET MVC version disclosed", "High"),
    ("X-Runtime", "Ruby/Rails runtime version disclosed", "Medium"),
    ("X-Version", "Application version information disclosed", "Medium"),
    ("X-Generator", "CMS/generator information disclosed", "Low"),
    ("Via", "Proxy/gateway information disclosed", "Low"),
    ("X-Backend", "Backend server routing disclosed", "High"),
    ("X-Backend-Server", "Backend server name disclosed", "High"),
    ("X-Debug-Token", "Debug token exposed in response headers", "High"),
    ("X-Debug-Token-Link", "Debug toolbar URL exposed", "Critical"),
    ("X-Drupal-Cache", "Drupal caching information disclosed", "Low"),
    ("X-Drupal-Dynamic-Cache", "Drupal dynamic cache status disclosed", "Low"),
    ("X-Varnish", "Varnish caching infrastructure disclosed", "Low"),
    ("X-Cache", "CDN/caching layer information disclosed", "Low"),
    ("CF-Ray", "Cloudflare ray identifier disclosed", "Low"),
    ("OpenSSL", "OpenSSL version disclosed in headers", "Medium"),
]

# Infrastructure headers.
INFRASTRUCTURE = [
    "X-Amz-Id-2", "X-Amz-Request-Id", "X-Amz-Cf-Id", "X-Server-Powered-By", "X-Server-Name", "X-Server-Host",
    "X-Served-By", "X-Served-From", "X-Backend-Host", "X-Proxy-Cache", "X-Proxy-Server", "X-Host",
    "X-Cluster-Name", "X-Node-Name", "X-Application-Context", "X-Envoy", "X-Kong", "X-Tyk",
]
