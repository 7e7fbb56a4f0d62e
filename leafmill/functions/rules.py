"""Fixed values of the text rules: phrases, word lists, patterns, limits.

Everything in this module is a fixed value that decides results; the logic
that uses them lives in the other modules of this package.
"""

import re


def any_of(phrases):
    """Regex alternation of literal phrases (same text works in Java and RE2)."""
    return "(?:" + "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", p) for p in phrases) + ")"


# --- fixed values: web boilerplate -------------------------------------------------
HARD_PREFIXES = [
    "share this", "share article", "share on", "share via", "copy link", "subscribe",
    "sign up", "newsletter", "advertisement", "cookie policy", "all rights reserved",
    "follow us", "related articles", "related reading", "recommended reading", "read more",
    "more from", "about the author", "about the authors", "author bio", "leave a comment",
    "comments", "discussion", "site index", "site information", "follow on", "follow us on",
    "more to explore",
]
HEADING_PHRASES = [
    "related articles", "read more", "recommended reading", "more from", "about the author",
    "about the authors", "comments", "discussion", "newsletter", "subscribe",
]
UI_PHRASES = [
    "open in app", "view all", "show more", "continue reading", "back to top", "next article",
    "previous article", "site index", "site information", "comments", "share", "print", "email",
    "facebook", "twitter", "x", "linkedin", "reddit",
]
STOP_HEADINGS = [
    "related articles", "related reading", "recommended reading", "read more", "more from",
    "about the author", "about the authors", "comments", "discussion", "newsletter", "subscribe",
    "latest posts", "latest news", "site index", "site information", "about this site",
    "follow us",
]
SOCIAL_TOKENS = [
    "facebook", "twitter", "x", "linkedin", "reddit", "whatsapp", "telegram", "email", "print",
    "copy link", "share", "share this", "share article",
]
SOCIAL_STARTS = ["share on ", "share via ", "follow on "]
AD_EXACT = ["safeframe container", "advertisement", "sponsored", "promoted content", "ad choices"]
AD_TOKENS = [
    "safeframe", "doubleclick", "googlesyndication", "ad choices", "advertisement", "sponsored",
]
ACTION_TOKENS = [
    "share", "sharing", "comment", "comments", "reply", "replies", "save", "bookmark", "print",
    "email", "copy", "link", "follow", "post", "facebook", "twitter", "x", "linkedin", "reddit",
    "whatsapp", "telegram", "threads", "open", "app", "menu",
]
UTILITY_TOKENS = [
    "site", "index", "information", "privacy", "policy", "terms", "service", "contact",
    "accessibility", "about", "help", "center", "customer", "support",
]
SITE_INFO_PHRASES = [
    "privacy policy", "terms of service", "terms of use", "contact us", "about us", "advertise",
    "accessibility", "newsletters", "help center", "customer service", "site information",
    "site index", "all rights reserved",
]
CREDIT_PREFIXES = [
    "photo", "photograph by", "photo by", "photo illustration by", "image", "image credit",
    "photo credit", "credit", "credits", "illustration by", "video by", "source:",
]
ACK_PREFIXES = [
    "reporting was contributed by", "reporting contributed by", "additional reporting by",
    "contributed by", "compiled by", "produced by", "edited by", "fact-checked by",
    "research by", "photographs by", "photos by", "graphics by", "video by",
]
RIGHTS_PUBLISHERS = [
    "wall street journal", "dow jones", "associated press", "new york times",
    "washington post", "bloomberg",
]
FOOTER_PUBLISHERS = [
    "the wall street journal", "dow jones & company, inc.", "dow jones", "new york times",
    "washington post", "bloomberg", "associated press",
]
HASH_PATTERN = r"\b[a-f0-9]{24,}\b"
NAV_SEPARATORS = [" | ", " · ", " • ", " / "]
TOKEN_TRIM = r",.:;!?()\[\]\"'"
LEAD_PUBLISHER_LABEL = (
    r"(?i)^(?:the wall street journal|new york times|washington post|bloomberg|associated press)"
    r"\b[\s:,\-–—]+"
)
LEAD_PUBLISHER_FOOTER = (
    r"(?i)^(?:\s*[a-f0-9]{24,}\s+)?(?:the wall street journal|dow jones(?:\s*&\s*company,\s*inc\.)?"
    r"|dow jones|new york times|washington post|bloomberg|associated press)\b[\s:,-]*"
)
TRAIL_COPYRIGHT_FOOTER = (
    r"(?i)(?:\s+|[—\-:]\s*)(?:the wall street journal\s+)?copyright(?:\s+|[©©])?.*?"
    r"(?:all rights reserved\.?)(?:\s+[a-f0-9]{24,})?(?:\s+the wall street journal)?\s*$"
)
TRAIL_PUBLISHER_FOOTER = (
    r"(?i)(?:\s+|[—\-:]\s*)(?:[a-f0-9]{24,}\s+)?(?:the wall street journal"
    r"|dow jones(?:\s*&\s*company,\s*inc\.)?|dow jones|new york times|washington post|bloomberg"
    r"|associated press)\s*$"
)
RIGHTS_SENTENCE = r"(?i)all rights reserved\.?"
COPYRIGHT_TAIL_NOISE = r"(?i)^(?:\s+|\s*[a-f0-9]{24,}\s*)+"

# --- fixed values: web containers ---------------------------------------------------
NOISY_CONTAINER_PHRASES = [
    "nav", "menu", "footer", "header", "sidebar", "share", "social", "cookie", "consent",
    "banner", "promo", "newsletter", "comment", "comments", "discussion", "related",
    "recommended", "breadcrumb", "toolbar", "pagination", "subscribe", "modal", "popup",
    "outbrain", "taboola", "rail", "masthead", "safeframe", "doubleclick", "googlesyndication",
    "advert", "advertisement", "ad slot",
]
INLINE_NOISE_PHRASES = [
    "share", "social", "comment", "comments", "discussion", "reply", "footer", "site info",
    "site information", "newsletter", "subscribe", "breadcrumb", "safeframe", "advertisement",
    "advert", "sponsored", "promo",
]
UI_MARKER_PHRASES = [
    "share", "social", "comment", "comments", "discussion", "reply", "footer", "site index",
    "site info", "site information", "navigation", "nav", "toolbar", "menu", "actions",
    "button", "cta", "related", "recommended", "newsletter", "subscribe", "signin", "sign in",
    "signup", "sign up", "breadcrumb", "safeframe", "ad slot", "advert", "advertisement",
    "sponsored",
]
ARTICLE_MARKERS = ["article", "content", "post", "story", "entry", "markdown", "body"]
NOISY_BLOCK_STARTS = [
    "share this", "sign up", "subscribe", "read more", "advertisement", "cookie policy",
    "all rights reserved", "follow us", "related articles",
]
PRUNED_CLASSES = [
    "related", "recommended", "newsletter", "signup", "subscribe", "comments", "comment",
    "social", "share", "advertisement", "ad", "promo", "cookie", "breadcrumb", "sidebar",
    "post-footer", "single-post-section", "footer-wrap",
]
DROPPED_TAGS = [
    "nav", "footer", "header", "aside", "iframe", "canvas", "button", "select", "textarea",
    "dialog",
]
DROPPED_CLASSES = ["sr-only", "visually-hidden", "post-footer", "single-post-section", "footer-wrap"]
DROPPED_ROLES = ["navigation", "complementary"]
STRUCTURAL_TAGS = [
    "article", "main", "section", "div", "aside", "nav", "ul", "ol", "figure", "header", "footer",
]
BLOCK_TAGS = [
    "html", "body", "article", "main", "section", "div", "aside", "nav", "header", "footer", "ul",
    "ol", "li", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "td",
    "th", "figure", "figcaption", "title", "head", "hr", "br", "dl", "dt", "dd",
]
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
CHALLENGE_PHRASES = [
    "<title>checking your browser", "javascript required", "__challenge", "i am human",
    "confirm you are human", "we need to check you're not a robot", "x-hashcash-solution",
    "please enable js and disable any ad blocker", "captcha-delivery.com",
    "geo.captcha-delivery.com",
]
ANCHOR_STOPS = [
    "related reading", "related articles", "recommended reading", "read more", "more from",
    "share this", "share article", "email alerts", "stay up-to-date", "subscribe", "sign up",
    "about the author", "about the authors", "author bio", "contact us",
]
ANCHOR_STOPS_BY_HOST = {
    "siam.org": [
        "publish with siam", "join siam", "siam news blog", "latest news", "featured articles",
    ],
}
TAIL_HEADING_WORDS = ["related", "more from", "subscribe", "newsletter", "comments"]
METADATA_BAD_STARTS = ["share", "subscribe", "read more", "advertisement"]

# --- fixed values: plain text -------------------------------------------------------
PLAIN_METADATA_MARKERS = [
    "@", "university", "department", "institute", "college", "laboratory", "lab", "school",
    "correspondence", "affiliation", "author", "authors", "by ",
]
