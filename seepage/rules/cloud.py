"""Cloud resource and identifier patterns (all matched without case)."""

from seepage.rules import Rule

MODULE = "cloud_exposure"

# Resource patterns, names and rule severities.
RULES = [
    Rule("aws_s3_bucket_url", "AWS S3 Bucket URL",
         r"(https?://[a-zA-Z0-9.-]+\.s3\.amazonaws\.com(?:/[^\s\"'>)\]\)]*)?)", 1, (".s3.amazonaws.com",), gate="host", tier="Medium"),
    Rule("aws_s3_bucket_arn", "AWS S3 Bucket ARN", r"arn:aws:s3:::[a-zA-Z0-9.-]+", 0, ("arn:aws:s3:::",), gate="arn", tier="Medium"),
    Rule("aws_s3_bucket_ref", "AWS S3 Bucket Reference",
         r"(?i)(['\"]bucket['\"]\s*[:=]\s*['\"][a-zA-Z0-9._-]+['\"])", 1, ("bucket",), tier="Low"),
    Rule("aws_ec2_ref", "AWS EC2 Reference",
         r"(?i)(ec2-[0-9]+-[0-9]+-[0-9]+-[0-9]+\.(?:compute|us-east|us-west|eu-west|eu-central|ap-southeast|ap-northeast|sa-east)\.amazonaws\.com)",
         1, ("ec2-",), gate="host", tier="Low"),
    Rule("aws_rds_ref", "AWS RDS Reference", r"(?i)([a-zA-Z0-9-]+\.(?:rds|rds\.amazonaws)\.com)", 1,
         (".rds.com", ".rds.amazonaws.com"), gate="host", tier="Medium",
         fast=r"(?i)(?:\G|(?<![a-zA-Z0-9-]))([a-zA-Z0-9-]++\.(?:rds|rds\.amazonaws)\.com)"),
    Rule("aws_elb_ref", "AWS ELB Reference",
         r"(?i)([a-zA-Z0-9-]+-\d+\.(?:us-east|us-west|eu-west|eu-central|ap-southeast|ap-northeast)\.elb\.amazonaws\.com)",
         1, (".elb.amazonaws.com",), gate="host", tier="Low",
         fast=r"(?i)(?:\G|(?<![a-zA-Z0-9-]))([a-zA-Z0-9-]+-\d+\.(?:us-east|us-west|eu-west|eu-central|ap-southeast|ap-northeast)\.elb\.amazonaws\.com)"),
    Rule("aws_cloudfront", "AWS CloudFront Distribution",
         r"(https?://[a-zA-Z0-9]+\.cloudfront\.net(?:/[^\s\"'>)\]\)]*)?)", 1, (".cloudfront.net",), gate="host", tier="Medium"),
    Rule("aws_lambda", "AWS Lambda Function", r"(arn:aws:lambda:[a-z0-9-]+:\d+:function:[a-zA-Z0-9-_]+)", 1,
         ("arn:aws:lambda:",), gate="arn", tier="Medium"),
    Rule("aws_iam_arn", "AWS IAM ARN", r"(arn:aws:iam::\d+:(?:user|role|group|policy)/[a-zA-Z0-9-_]+)", 1,
         ("arn:aws:iam::",), gate="arn", tier="High"),
    Rule("azure_storage", "Azure Storage Account",
         r"(https?://[a-zA-Z0-9]+\.(?:blob|file|queue|table)\.core\.windows\.net(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".core.windows.net",), gate="host", tier="Medium"),
    Rule("azure_appservice", "Azure App Service",
         r"(https?://[a-zA-Z0-9-]+\.azurewebsites\.net(?:/[^\s\"'>)\]\)]*)?)", 1, (".azurewebsites.net",), gate="host", tier="Medium"),
    Rule("azure_db", "Azure Database", r"(https?://[a-zA-Z0-9-]+\.database\.windows\.net(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".database.windows.net",), gate="host", tier="Medium"),
    Rule("azure_redis", "Azure Redis Cache",
         r"(https?://[a-zA-Z0-9-]+\.redis\.cache\.windows\.net(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".redis.cache.windows.net",), gate="host", tier="Medium"),
    Rule("azure_cdn", "Azure CDN", r"(https?://[a-zA-Z0-9-]+\.azureedge\.net(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".azureedge.net",), gate="host", tier="Medium"),
    Rule("azure_vm", "Azure VM",
         r"(https?://[a-zA-Z0-9-]+\.(?:cloudapp|westus|eastus|westeurope|northeurope|southeastasia)\.azure\.com)", 1,
         (".azure.com",), gate="host", tier="Low"),
    Rule("gcp_storage", "GCP Storage Bucket",
         r"(https?://storage\.googleapis\.com/[a-zA-Z0-9_-]+(?:/[^\s\"'>)\]\)]*)?)", 1,
         ("://storage.googleapis.com/",), gate="host", tier="Medium"),
    Rule("gcp_cloudfunction", "GCP Cloud Function",
         r"(https?://[a-zA-Z0-9-]+\.cloudfunctions\.net(?:/[^\s\"'>)\]\)]*)?)", 1, (".cloudfunctions.net",), gate="host", tier="Medium"),
    Rule("gcp_appengine", "GCP App Engine", r"(https?://[a-zA-Z0-9-]+\.appspot\.com(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".appspot.com",), gate="host", tier="Medium"),
    Rule("gcp_compute", "GCP Compute Engine",
         r"(https?://[a-zA-Z0-9-]+\.(?:us-central1|europe-west1|asia-east1)\.compute\.amazonaws\.com)", 1,
         (".compute.amazonaws.com",), gate="host", tier="Low"),
    Rule("gcp_bigquery", "GCP BigQuery",
         r"(?i)(['\"]projectId['\"]\s*[:=]\s*['\"][a-zA-Z0-9-]+['\"][\s,]*['\"]datasetId['\"])", 1, ("datasetid",),
         tier="Medium"),
    Rule("digitalocean", "DigitalOcean",
         r"(https?://[a-zA-Z0-9-]+\.(?:digitaloceanspaces|ondigitalocean)\.com(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".digitaloceanspaces.com", ".ondigitalocean.com"), gate="host", tier="Low"),
    Rule("heroku", "Heroku App", r"(https?://[a-zA-Z0-9-]+\.herokuapp\.com(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".herokuapp.com",), gate="host", tier="Low"),
    Rule("firebase", "Firebase Project", r"(https?://[a-zA-Z0-9-]+\.firebaseio\.com(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".firebaseio.com",), gate="host", tier="Medium"),
    Rule("firebase_app", "Firebase App", r"(https?://[a-zA-Z0-9-]+\.firebaseapp\.com(?:/[^\s\"'>)\]\)]*)?)", 1,
         (".firebaseapp.com",), gate="host", tier="Medium"),
    Rule("cloud_generic", "Cloud Generic Reference", r"(?i)(['\"](?:cloud|aws|azure|gcp|gke|eks|aks)['\"]\s*[:=])", 1, tier="Low"),
]

# Identifier patterns.
IDENTIFIERS = [
    Rule("aws_account_id", "AWS Account ID", r"(arn:aws:iam::(\d{12}):)", 1, ("arn:aws:iam::",), gate="arn"),
    Rule("aws_user_arn", "AWS User ARN", r"(arn:aws:iam::\d{12}:user/[a-zA-Z0-9-_]+)", 1, ("arn:aws:iam::",), gate="arn"),
    Rule("azure_subscription_id_pattern", "Azure Subscription ID", r"(subscriptions/([a-f0-9\-]{36})/)", 1,
         ("subscriptions/",)),
    Rule("gcp_project_id", "GCP Project ID", r"(projects/([a-zA-Z0-9\-]{6,30})/)", 1, ("projects/",)),
]

# Gates and widths.
STATUSES = (200, 201, 202)
WINDOW = 80
