"""The fixed strings that analyses look for anywhere in a page, and one column that tells which of them it holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marks import Literals
from .tech_rules import AI_BUILDERS

#: Keywords, matched as substrings of lower-case text.
SOCIAL_PROOF = ("review", "testimonial", "rated", "customers", "clients", "trust pilot", "trustpilot", "verified", "stars", "rating", "g2 crowd", "capterra", "/5", "out of 5")
TRUST = ("guarantee", "secure", "ssl", "certified", "award", "accredited", "privacy", "safe", "money back", "refund", "100%", "no risk", "verified")
COOKIE_BANNER = (
    "cookieconsent", "cookie-consent", "cookie-notice", "cookie-banner", "onetrust", "cookiebot", "cc-window", "gdpr-cookie", "cookie-law", "cookie_consent", "cookie-accept", "js-cookie", "cookie-popup",
    "we use cookies", "accept cookies", "cookie preferences",
)
#: Chat services and widgets.
LIVE_CHAT = (
    "crisp.chat", "client.crisp.chat", "$crisp", "intercom", "widget.intercom.io", "intercomcdn", "js.driftt.com", "drift.com/", "driftt.com", "tawk.to", "tawk_api", "embed.tawk.to", "tidio", "code.tidio.co",
    "freshchat", "wchat.freshchat.com", "freshdesk", "freshworks", "zopim", "zendesk", "zdassets.com", "livechat.com", "cdn.livechatinc.com", "livechatinc", "helpscout", "beacon-v2", "beacon.helpscout", "olark", "smartsupp",
    "js.hs-scripts.com", "hubspot", "chatwoot", "getgist.com", "salesiq.zoho.com", "zoho.com/salesiq", "liveagent", "reamaze", "podium.com", "qualified.com", "chatra.io", "userlike.com", "purechat.com", "snapengage", "comm100", "kayako",
    "chat-widget", "chat_widget", "livechat-widget", "chat-bubble", "chatbubble", "chat-launcher", "__lc", "lc_chat", "lc2", "chatbot", "chat-bot", "chat_bot", "togglechatbot", "chatbot-frame", "chatbot-container", "chatbot-button",
    "chatbot-toggle", "chatbot-icon", "openchat", "open-chat", "showchat",
)
#: Embedded videos.
VIDEO_MARKS = ("<video", "youtube.com/embed", "youtube-nocookie.com/embed", "player.vimeo.com", "fast.wistia.com")
#: Plugins that always make a sitemap.
SITEMAP_PLUGINS = ("yoast", "rank math", "rankmath", "aioseo", "all-in-one-seo", "seopress")
#: Addresses of sitemaps.
SITEMAPS = ("sitemap_index.xml", "/sitemap.xml")
#: Markers of AI without a builder.
AI_MARKERS = ('generator" content="ai', "ai-generated", "generated by ai", "created with ai", "powered by ai")
#: What bears out the claims of a title.
COMPARISON = ("<table", "vs.", " vs ", "compared to", "alternative")
STEP_LIST = ("<ol",)
ACTION = ("<form", "<button")
#: What pages of a kind say, anywhere.
PHRASES = {
    "cart": ("add to cart", "add to bag", "remove from cart"), "checkout": ("proceed to checkout", "go to checkout", "view cart", "shopping cart"), "purchase": ("buy now", "shop now", "order now"),
    "fulfilment": ("free shipping", "ships in", "in stock", "out of stock", "add to wishlist"), "trial": ("free trial", "start your free trial", "try for free", "14-day", "30-day trial"),
    "subscription": ("per month", "per user", "per seat", "billed annually", "monthly plan", "annual plan"), "signup": ("sign up free", "create your account", "start for free"),
    "app": ("dashboard", "workspace", "integrations", "api access"), "person": ("i'm a ", "i am a ", "my name is", "hire me", "available for"),
    "creative": ("designer", "developer", "photographer", "illustrator", "freelancer", "creative"), "work": ("case study", "case studies", "my projects", "selected work", "recent work"),
    "published": ("posted on", "published on", "published:", "written by", "author:", "by the editors"), "dated": ("<time", "datetime=", "article:published_time"),
    "replies": ("comments (", "leave a comment", "reply to", "subscribe to our newsletter"), "posts": ("next post", "previous post", "related articles", "more from this author"),
    "urgency": ("limited time", "offer expires", "only left", "spots remaining", "claim your", "act now"), "assurance": ("100% free", "no credit card required", "no credit card", "cancel anytime", "money-back guarantee"),
    "services": ("our services", "what we offer", "what we do", "how we help", "get a quote", "request a quote", "book a ", "schedule a ", "free consultation", "call us today"),
    "clients": ("years of experience", "years experience", "trusted by", "clients include", "our clients"), "about": ("about us", "our story", "our history", "who we are"),
    "careers": ("careers", "join our team", "job openings", "we're hiring"), "press": ("press", "newsroom", "media kit", "press release", "in the news"), "investors": ("investors", "investor relations", "annual report", "shareholder"),
}

_PAGE = Literals(
    SOCIAL_PROOF, TRUST, COOKIE_BANNER, LIVE_CHAT, VIDEO_MARKS, SITEMAP_PLUGINS, SITEMAPS, AI_MARKERS, COMPARISON, STEP_LIST, ACTION, *PHRASES.values(), *(patterns for _, patterns in AI_BUILDERS)
)


def with_marks(df: DataFrame) -> DataFrame:
    """Adds ``marks``, found in one pass over ``lower``, unless it is there. Some strings a page, so later steps need not carry the page itself."""
    return df if "marks" in df.columns else df.withColumn("marks", _PAGE.found(F.coalesce("lower", F.lit(""))))


def holds(*words: str) -> Column:
    """Whether a page with ``marks`` holds any of ``words``."""
    return _PAGE.holds_any(F.col("marks"), words)


def number_held(words: Iterable[str]) -> Column:
    """How many of ``words`` it holds."""
    return sum((holds(w).cast("int") for w in words), F.lit(0))
