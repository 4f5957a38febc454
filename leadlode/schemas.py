"""Declared schemas of the tables and messages."""

from __future__ import annotations

LEADS = (
    "id string, company_name string, company_description string, contact_email string,"
    " subject string, sent_at timestamp, opened boolean, clicked boolean, replied boolean,"
    " bounced boolean, probability_score int, suggested_action string,"
    " email_source_context string, company_id int"
)
CLIENTS = (
    "id bigint, company_id int, name string, website string, industry string, country string,"
    " trust_score int, relevance_reason string, status string, email string, phone string,"
    " phones string, linkedin_company string, contact_source_url string,"
    " contact_source_page string, contact_source_label string, contact_source_context string,"
    " logo_url string, search_query string, created_at timestamp"
)
EMAIL_HISTORY = (
    "id bigint, client_id bigint, company_id int, email_type string, label string,"
    " subject string, body string, recipient_email string, status string, created_at timestamp"
)
ENRICHED_CONTACTS = (
    "id bigint, company_name string, website_url string, email string, phone string,"
    " stakeholder string, context_snippet string, email_source_context string,"
    " source_page string, source_label string, all_contacts_json string,"
    " enriched_at timestamp, company_id int"
)
COMPANIES = (
    "id int, name string, website string, industry string, services string,"
    " target_customers string, description string, ai_enriched_profile string,"
    " created_at timestamp"
)
SEARCH_HITS = (
    "query string, page int, pos int, provider string, url string, title string, content string"
)
VERDICT = (
    "is_junk boolean, industry_match boolean, lead_type string, confidence int, reason string,"
    " official_company_name string, detected_country string"
)
WEBHOOK_PAYLOAD = "type string, data struct<to: array<string>>"
COUNTRIES = "country string, code string, cities array<string>"
PROGRESS = "processed_domains array<string>, query_progress map<string,int>"
CONTACT_SOURCE = "struct<url: string, page: string, label: string, context: string>"
DISCOVERY_EVENT = (
    "type string, query string, target int, page int, qualified int, processed int,"
    " totalQualified int, summary string, id string, name string, website string,"
    " displayUrl string, domain string, industry string, country string, city string,"
    " snippet string, matchReason string, matchConfidence int, trustScore int,"
    " trustStatus string, email string, phone string, phones array<string>,"
    " emails array<string>, linkedin string, leadType string, source string,"
    f" dataSource string, unverified boolean, contactSource {CONTACT_SOURCE}"
)
CONTACT_BUNDLE = (
    "all_emails array<string>, email_meta array<struct<email: string,"
    " sources: array<struct<url: string, page: string, label: string>>,"
    " source_url: string, source_page: string, source_label: string>>,"
    " phones array<string>, linkedin_company string, linkedin_people array<string>,"
    " contact_page_url string, source_label string, found boolean, stage int"
)
CLIENT_FIELDS = (
    "name", "website", "industry", "country", "trust_score", "relevance_reason", "status",
    "email", "phone", "phones", "linkedin_company", "contact_source_url", "contact_source_page",
    "contact_source_label", "contact_source_context", "logo_url", "search_query",
)
