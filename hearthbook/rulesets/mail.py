"""Fixed values for mail handling."""

# Substrings of a sender address that mark automated mail.
AUTOMATED_SENDER_PARTS = [
    "noreply", "no-reply", "donotreply", "notifications@", "mailer-daemon", "automated@",
    "marketing@", "updates@", "hello@send.", "mail@email.", "editor@members.", "hi@marketing.",
    "pkginfo@", "drive-shares", "workspace-noreply", "businessprofile-noreply",
    "account-services", "gustonoreply",
]

# Sender domain endings that mark bulk mail.
BULK_DOMAINS = [
    "hipcamp.com", "send.hipcamp.com", "e.stripe.com", "crateandbarrel.com",
    "mail.crateandbarrel.com", "inform.bill.com", "email.adobe.com", "e2.overtons.com",
    "email.eastwood.com", "members.wayfair.com", "redditmail.com", "mail.coinbase.com",
    "comm.vosker.com", "marketing.hipcamp.com", "e.newyorktimes.com", "ccsend.com",
    "beehiiv.com", "convertkit.com", "shopify.com", "klaviyo.com", "facebookmail.com",
    "marketing.com",
]

# Precedence header values that mark bulk mail.
BULK_PRECEDENCE = ["bulk", "list", "junk"]

# Service accounts that are never enriched.
SERVICE_ADDRESSES = [
    "support@earthclassmail.com", "dse_na4@docusign.net",
    "messenger@messaging.squareup.com", "messaging-service@post.xero.com",
]
SERVICE_DOMAINS = [
    "reply2.squareup.com", "brex.com", "docusign.net", "squareup.com", "xero.com", "stripe.com",
]

# Role words that open a signature title line.
TITLE_WORDS = [
    "CEO", "CTO", "CFO", "COO", "VP", "Director", "Manager", "Partner", "Attorney", "Architect",
    "Engineer", "Designer", "Founder", "President", "Principal", "Associate", "Consultant",
    "Advisor", "Agent", "Broker", "Editor", "Producer", "Curator", "Professor", "Dr\\.", "PhD",
]

# Fixed value: phone number in a signature block.
SIGNATURE_PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"

# Lines that separate a signature from the body.
SIGNATURE_MARKS = ["--", "---", "—"]

# Body and bundle limits.
MAX_BODY_CHARS = 2000
MAX_BUNDLE_CHARS = 50000
MIN_BODY_CHARS = 30

# The relationship types an enrichment may carry.
RELATIONSHIP_TYPES = [
    "collaborator", "vendor", "contractor", "patron", "collector", "press", "peer", "family",
    "friend", "legal", "financial", "government", "investor", "unknown",
]
# Types that make a contact relevant for the cast list.
CAST_TYPES = [
    "collaborator", "investor", "press", "collector", "family", "friend", "legal", "financial",
    "government", "patron",
]
# Types that justify a new person page.
PAGE_TYPES = [
    "collaborator", "investor", "press", "legal", "financial", "government", "family", "friend",
]

# Fields filled from other rows when accounts are merged.
FILLED_FIELDS = [
    "name", "phone", "organization", "role_title", "city", "state", "relationship_summary",
    "relationship_type", "key_topics", "projects_in_common", "notable_context",
    "communication_style", "vault_page", "collector_type", "total_purchases", "gc_website",
]

# Column order of the master contact table.
MASTER_COLUMNS = [
    "name", "email", "phone", "organization", "role_title", "city", "state",
    "relationship_summary", "relationship_type", "relationship_strength", "key_topics",
    "projects_in_common", "notable_context", "communication_style", "total_emails",
    "emails_from", "emails_to", "first_contact", "last_contact", "communication_gap_days",
    "source_account", "vault_page", "vault_match_status", "collector_type",
    "collector_priority", "total_purchases", "products_purchased", "gc_website",
    "gc_birthday", "enrichment_tier", "has_enrichment",
]

# Address-book and CRM column names and the names they get here.
ADDRESS_BOOK_EMAILS = ["E-mail 1 - Value", "E-mail 2 - Value", "E-mail 3 - Value"]
ADDRESS_BOOK_FIELDS = {
    "gc_org": "Organization Name", "gc_title": "Organization Title",
    "gc_phone": "Phone 1 - Value", "gc_phone2": "Phone 2 - Value",
    "gc_city": "Address 1 - City", "gc_region": "Address 1 - Region",
    "gc_country": "Address 1 - Country", "gc_address": "Address 1 - Formatted",
    "gc_website": "Website 1 - Value", "gc_birthday": "Birthday",
    "gc_nickname": "Nickname", "gc_notes": "Notes",
}
CRM_FIELDS = {
    "crm_name": "Collector Name", "crm_phone": "Phone", "crm_city": "City",
    "crm_state": "State/Province", "crm_country": "Country",
    "crm_collector_type": "Collector Type", "crm_priority": "Priority",
    "crm_first_order": "First Order Date", "crm_last_order": "Last Order Date",
    "crm_total_orders": "Total Orders", "crm_gross_sales": "Gross Sales ($)",
    "crm_net_sales": "Net Sales ($)", "crm_products": "Products Purchased",
    "crm_tags": "Tags", "crm_outreach_status": "Outreach Status", "crm_notes": "Notes",
}

# File-name parts that mark a JSON file as not being a contact bundle.
NON_BUNDLE_PARTS = ["manifest", "megabatch", "results_", "batch_"]
