"""What a page offers its visitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_marks import COOKIE_BANNER, LIVE_CHAT, SOCIAL_PROOF, TRUST, holds, number_held, with_marks
from .tokens import attr, contains_any, decoded, pick, values

#: Keywords, matched as substrings of lower-case text.
CTA = (
    "buy", "get started", "sign up", "signup", "try", "free trial", "start", "book", "order", "subscribe", "contact us", "shop now", "get demo", "book a demo", "request demo", "download",
    "register", "join", "claim", "add to cart", "checkout", "get quote",
)
NEWSLETTER = ("newsletter", "subscribe", "subscription", "mailing list", "email updates", "get updates", "stay updated", "join our list", "weekly digest", "updates in your inbox")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "wistia.com", "loom.com")
#: Characters around the first e-mail input in which a newsletter keyword counts.
NEAR = 500


def _texts() -> Column:
    """Lower-case texts of anchors and buttons."""
    inner = F.regexp_extract_all("bare", F.lit(r"(?is)<(?:a|button)(?=[\s>])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*')*+>(.*?)(?=</(?:a|button)\s*>|<a[\s>]|<button[\s>]|$)"), F.lit(1))
    return F.transform(inner, lambda x: F.lower(F.trim(decoded(F.regexp_replace(x, r"<[^>]*+>", ""), F.col("refs")))))


def ux_signals(df: DataFrame) -> DataFrame:
    """``ux``: flags and counts of a prepared page. Keywords match as substrings, in any place of the page."""
    lower = F.col("lower")
    df = with_marks(df).withColumn("_texts", _texts()).withColumn("_hrefs", F.transform(values(pick("a"), "href"), F.lower))
    ctas = F.size(F.filter("_texts", lambda x: contains_any(x, CTA)))
    forms = F.size(pick("form"))
    phones = F.regexp_extract_all(lower, F.lit(r"\+?\d[\d\s\-()]{8,19}"), F.lit(0))
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    contact = F.exists("_hrefs", lambda h: h.rlike("^(mailto:|tel:)")) | F.exists(phones, lambda x: digits(x).between(7, 15))
    trust = number_held(TRUST) >= 2
    video = (F.size(pick("video")) > 0) | F.exists(values(pick("iframe"), "src"), lambda s: contains_any(F.lower(s), VIDEO_HOSTS))
    privacy = F.exists("_hrefs", lambda h: h.contains("privacy")) | F.exists("_texts", lambda x: x.contains("privacy policy"))
    mobile = F.exists("tags", lambda t: (t["tag"] == "meta") & (F.lower(attr(t, "name")) == "viewport"))
    at = F.least(*[F.nullif(F.instr("lower", m), F.lit(0)) for m in ('type="email"', "type='email'")])
    near = F.substring(lower, F.greatest(F.lit(1), at - NEAR), F.least(at - 1, F.lit(NEAR)) + NEAR)
    flags = {
        "has_cta": ctas > 0, "cta_count": ctas, "has_forms": forms > 0, "form_count": forms, "social_proof": holds(*SOCIAL_PROOF), "trust_signals": trust, "contact_info": contact,
        "mobile_ready": mobile, "video": video, "privacy_policy": privacy, "cookie_banner": holds(*COOKIE_BANNER), "live_chat": holds(*LIVE_CHAT),
        "newsletter": F.coalesce(contains_any(near, NEWSLETTER), F.lit(False)),
    }
    return df.withColumn("ux", F.struct(*[v.alias(k) for k, v in flags.items()])).drop("_texts", "_hrefs")
