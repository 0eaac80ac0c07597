"""API documentation paths and markers."""

from seepage.rules import Rule

MODULE = "api_docs"

# Probed paths, in probe order.
PATHS = [
    "api/documentation", "api/docs", "api/swagger", "api/openapi",
    "api/v1/documentation", "api/v2/documentation", "api/v3/documentation",
    "api/graphql", "graphql", "graphiql", "graphql/playground",
    "swagger", "swagger/", "swagger-ui", "swagger-ui.html", "swagger-resources",
    "v2/api-docs", "v3/api-docs",
    "swagger.json", "openapi.json", "swagger.yaml", "openapi.yaml", "api/swagger.json", "api/openapi.json",
    "api-spec", "api-specification",
    "api/redoc", "redoc", "docs", "documentation",
    ".well-known/openid-configuration", ".well-known/oauth-authorization-server",
]

# Markers in order of precedence; rule_id is the group.
MARKERS = [
    Rule("swagger-ui", "Swagger UI detected", r"swagger-ui", tier="Medium"),
    Rule("swagger-ui", "Swagger UI bundle detected", r"SwaggerUIBundle", tier="Medium"),
    Rule("swagger-ui", "Swagger UI standalone preset detected", r"SwaggerUIStandalonePreset", tier="Medium"),
    Rule("swagger-ui", "Swagger JavaScript detected", r"swagger\.js", tier="Medium"),
    Rule("swagger-json", "Swagger JSON specification", r"\{.*\"swagger\"\s*:\s*\"", tier="High",
         fast=r"(?m:^)[^{\n]*+\{.*\"swagger\"\s*:\s*\""),
    Rule("swagger-json", "OpenAPI specification", r"\"openapi\"\s*:\s*\"", tier="High"),
    Rule("swagger-json", "API info object", r"\"info\"\s*:\s*\{.*\"version\"", tier="High"),
    Rule("swagger-json", "API paths defined", r"\"paths\"\s*:\s*\{", tier="High"),
    Rule("redoc", "Redoc detected", r"<redoc>", tier="Medium"),
    Rule("redoc", "Redoc initialization detected", r"redoc\.init", tier="Medium"),
    Rule("redoc", "Redoc JavaScript detected", r"redoc\.min\.js", tier="Medium"),
    Rule("graphql", "GraphQL query detected", r"query\s+\w+\s*\{", tier="Medium"),
    Rule("graphql", "GraphQL mutation detected", r"mutation\s+\w+\s*\{", tier="Medium"),
    Rule("graphql", "GraphQL subscription detected", r"subscription\s+\w+\s*\{", tier="Medium"),
    Rule("graphql", "GraphQL schema introspection detected", r"\"__schema\"", tier="Medium"),
    Rule("graphql", "GraphQL endpoint reference", r"graphql", tier="Medium"),
    Rule("graphiql", "GraphiQL IDE detected", r"GraphiQL", tier="Medium"),
    Rule("graphiql", "GraphiQL interface detected", r"graphiql", tier="Medium"),
]
SPECIFICATION = r"""\{.*"(?:swagger|openapi)"\s*:\s*"[^"]+".*\}"""
# Group 1 is the same text: a match from any brace can start at the first one.
SPECIFICATION_FAST = r"""^[^{]*+(\{.*"(?:swagger|openapi)"\s*:\s*"[^"]+".*\})"""

# Evidence shape.
LINES_AROUND = 2
