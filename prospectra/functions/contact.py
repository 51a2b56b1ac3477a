"""Phones, emails, links, and the scores made of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, strip

# Patterns, suffixes and words that decide what counts as a contact.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_CANDIDATE = r"[\+\d][\d\-\s\(\)\.]{6,}"
CARD_PHONE = r"((\+?\d{1,4}[ -]?)?(\d{3,6}[ -]?\d{3,6}))"
FILE_SUFFIXES = r"\.(png|jpg|jpeg|gif|webp|svg|js|css|pdf)$"
CONTACT_WORDS = "contact|about|reach|enquiry|touch|location"
BLOCK_WORDS = "recaptcha|unusual traffic|consent\\.google\\.com"
CLOSED_WORDS = "(permanently|temporarily) closed"
HELD_STATUS = "clienthold|serverhold|inactive"
PARKED_WORDS = "parked|for sale"
RENDER_STATUS = (403, 401, 406, 429)
RENDER_MARKS = 'id="root"|wix|nuxt'


def local_phone(raw: Column) -> Column:
    """struct(number, type) of a listing's phone: Mobile, Landline, Unknown, or both empty.

    Digits only; leading zeros go; leading 91 goes while over ten digits remain; 18... is refused; ten digits from 6 are
    mobile, from 1 to 5 a landline with a 0 in front. Nothing but zeros is an empty number of unknown type.
    """
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\D", "")
    number = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "^(?:91(?=[0-9]{9,}))+", "")
    kind = lambda n, t: F.struct(n.alias("number"), F.lit(t).alias("type"))
    return (
        F.when((digits == "") | number.startswith("18"), kind(F.lit(""), ""))
        .when(number.rlike("^[6-9][0-9]{9}$"), kind(number, "Mobile"))
        .when(number.rlike("^[1-5][0-9]{9}$"), kind(F.concat(F.lit("0"), number), "Landline"))
        .otherwise(kind(number, "Unknown"))
    )


def scraped_phone(raw: Column) -> Column:
    """struct(number, type) of a phone found on a page, in the form ``+91 <national>``; nulls where it isn't valid.

    A rule table for Indian numbers: ten digits, from 6 for mobiles, from 1 to 5 for landlines, after +91, 91 or 0. It
    is weaker than a numbering-plan library: foreign numbers and unassigned ranges aren't told apart.
    """
    trimmed = strip(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(trimmed, r"\D", "")
    foreign = trimmed.startswith("+") & ~digits.startswith("91")
    national = F.regexp_extract(digits, r"^(?:0{0,2}91|0)?([1-9][0-9]{9})$", 1)
    kind = lambda t: F.struct(F.concat(F.lit("+91 "), national).alias("number"), F.lit(t).alias("type"))
    return F.when(foreign | (national == ""), F.lit(None)).when(national.rlike("^[6-9]"), kind("Mobile")).when(national.rlike("^[1-5]"), kind("Landline"))


def phones_of(text: Column, kind: str) -> Column:
    """Sorted distinct numbers of one type among the phone candidates of a text."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE_CANDIDATE), F.lit(0)), scraped_phone)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda p: p["type"] == kind), lambda p: p["number"])))


def clean_email(raw: Column) -> Column:
    """Lower-cased address, or null for a file name or anything but an address."""
    text = F.lower(strip(raw))
    return F.when(text.rlike(f"^{EMAIL}$") & ~text.rlike(FILE_SUFFIXES), text)


def emails_of(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), clean_email)
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def mailto_address(href: Column) -> Column:
    return F.when(F.lower(strip(href)).startswith("mailto:"), F.split_part(F.substring(href, F.instr(href, ":") + 1, F.length(href)), F.lit("?"), F.lit(1)))


def email_domain(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(2))


def social_network(href: Column) -> Column:
    """The network a link belongs to; the first rule that fits wins (``x.com`` also inside other hosts)."""
    h = F.lower(strip(href))
    return (
        F.when(h.contains("linkedin.com/company") | h.contains("linkedin.com/in"), "linkedin")
        .when(h.contains("facebook.com") & ~h.contains("sharer"), "facebook")
        .when(h.contains("twitter.com") | h.contains("x.com"), "twitter")
        .when(h.contains("instagram.com"), "instagram")
    )


def last_social(links: Column, network: str) -> Column:
    """The last link to a network; none: empty."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(links, lambda x: x["href"]), lambda h: social_network(h) == network), F.lit(-1)), F.lit(""))


def unwrap_redirect(href: Column) -> Column:
    return F.when(href.startswith("/url?q="), F.split_part(F.split_part(href, F.lit("/url?q="), F.lit(2)), F.lit("&"), F.lit(1))).otherwise(F.coalesce(href, F.lit("")))


def with_scheme(url: Column) -> Column:
    u = strip(url)
    return F.when(u == "", u).when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def bare_url(url: Column) -> Column:
    """Lower case, without scheme, ``www.``, query, fragment and closing slashes."""
    u = F.regexp_replace(F.regexp_replace(F.lower(strip(url)), "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(u, r"[?#](?s:.*)$", ""), "/+$", "")


def url_key(url: Column) -> Column:
    """md5 of the bare url; blank or null: empty."""
    return F.when(filled(url).isNull(), F.lit("")).otherwise(F.md5(bare_url(url).cast("binary")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link, for the shapes found on pages: absolute, ``//host``, ``/path``, ``?query``, relative."""
    h = strip(href)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(page, h))
        .otherwise(F.concat(folder, F.regexp_replace(h, r"^(?:\./)+", "")))
    )


def contact_links(links: Column, base: Column, words: str = CONTACT_WORDS, most: int | None = 2) -> Column:
    """Links on the same site whose address or text tells of contacts; the first ``most`` in order of address."""
    useful = F.filter(
        links,
        lambda x: (F.lower(x["href"]).rlike(words) | F.lower(x["text"]).rlike(words)) & ~F.lower(x["href"]).rlike(r"%20|contact-form-7|^\s*(#|javascript:|tel:|mailto:)"),
    )
    full = F.filter(F.transform(useful, lambda x: resolve(base, x["href"])), lambda u: u.rlike("^https?://") & (netloc_of(u) == netloc_of(base)))
    out = F.array_sort(F.array_distinct(full))
    return out if most is None else F.slice(out, 1, most)


def page_is_valid(html: Column) -> Column:
    """At least 1000 bytes and no sign of a blocked request."""
    return F.coalesce((F.octet_length(html) >= 1000) & ~F.lower(html).rlike(BLOCK_WORDS), F.lit(False))


def needs_render(http_status: Column, html: Column, found_any: Column | None = None) -> Column:
    marked = F.coalesce(http_status.isin(*RENDER_STATUS), F.lit(False)) | F.coalesce(F.lower(html).rlike(RENDER_MARKS), F.lit(False))
    return marked if found_any is None else marked | ~found_any


def quality_score(http_status: Column, has_contact: Column, ssl: Column, mobile: Column, social_or_reviews: Column, performance: Column | None = None) -> Column:
    """0 to 100: 30 reachable, 30 contact, and 10 each for a valid certificate, mobile pages, social links or reviews, speed."""
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    parts = one(http_status.between(200, 399), 30) + one(has_contact, 30) + one(ssl == "valid", 10) + one(mobile, 10) + one(social_or_reviews, 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), parts + (one(performance, 10) if performance is not None else 0)))


def page_tags(ssl: Column | None, domain: Column | None, socials: Column, reviews: Column) -> Column:
    named = [F.when(x != "", F.concat(F.lit(f"{n}:"), x)) for n, x in (("ssl", ssl), ("domain", domain)) if x is not None]
    return F.array_compact(F.array(*named, F.when(socials, F.lit("has_social_links")), F.when(reviews, F.lit("has_reviews"))))


def contact_tier(has_mobile: Column, phone_type: Column, has_email: Column) -> Column:
    good = has_mobile | (phone_type == "Mobile") | has_email
    return F.when(F.coalesce(good, F.lit(False)), "Premium").otherwise("Ghost")


def fallback_tier(phone_type: Column, emails: Column) -> Column:
    """Tier of a lead whose site gave nothing."""
    good = (phone_type == "Mobile") | (filled(emails).isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), "Fallback").otherwise("Ghost")


def domain_state(payload: Column, now: Column) -> Column:
    """State of a domain from a stored registry answer (JSON): suspended, expired, exists, or unknown without a readable one."""
    parsed = F.from_json(payload, "status array<string>, events array<struct<eventAction:string,eventDate:string>>")
    ended = F.exists(F.coalesce(parsed["events"], F.array().cast("array<struct<eventAction:string,eventDate:string>>")), lambda e: (e["eventAction"] == "expiration") & (e["eventDate"].try_cast("timestamp") < now))
    held = F.exists(F.coalesce(parsed["status"], F.array().cast("array<string>")), lambda s: F.lower(s).rlike(HELD_STATUS))
    return F.when(F.try_parse_json(payload).isNull(), "unknown").when(F.coalesce(held, F.lit(False)), "suspended").when(F.coalesce(ended, F.lit(False)), "expired").otherwise("exists")


def whois_state(expires: Column, text: Column, now: Column) -> Column:
    """State of a domain from a stored WHOIS answer: by its end, else parked where its text says so; else unknown."""
    at = expires.try_cast("timestamp")
    told = F.coalesce(F.lower(text).rlike(PARKED_WORDS), F.lit(False))
    return F.when(filled(expires).isNotNull(), F.when(at.isNull(), "unknown").when(at < now, "expired").otherwise("exists")).when(told, "parked").otherwise("unknown")


def known_domain_state(registry: Column, expires: Column, text: Column, now: Column) -> Column:
    """The registry's state, or where that is unknown the one WHOIS tells."""
    return F.coalesce(F.nullif(domain_state(registry, now), F.lit("unknown")), whois_state(expires, text, now))


def ssl_state(not_after: Column, now: Column) -> Column:
    """State of a certificate from its stored end: valid, expired, or invalid where none can be read."""
    at = not_after.try_cast("timestamp")
    return F.when(at.isNull(), "invalid").when(at < now, "expired").otherwise("valid")


#: Calling codes and the least and most digits of national numbers behind them.
NUMBERING_PLANS = {
    "1": ("US", 10, 10), "7": ("RU", 10, 10), "27": ("ZA", 9, 9), "31": ("NL", 9, 9), "32": ("BE", 8, 9), "33": ("FR", 9, 9), "34": ("ES", 9, 9),
    "41": ("CH", 9, 9), "44": ("GB", 9, 10), "45": ("DK", 8, 8), "47": ("NO", 8, 8), "48": ("PL", 9, 9), "55": ("BR", 10, 11), "61": ("AU", 9, 9),
    "65": ("SG", 8, 8), "81": ("JP", 9, 10), "90": ("TR", 10, 10), "91": ("IN", 10, 10), "351": ("PT", 9, 9), "852": ("HK", 8, 8), "971": ("AE", 8, 9),
}


def country_number(raw: Column, home: str = "91") -> Column:
    """struct(country, code, national, state) of a number as written; null for a text without a digit.

    ``+`` and ``00`` start an international number, whose longest known calling code counts; other numbers are ``home``'s,
    without zeros in front. state: valid, too_short or too_long by the national numbers of that code, or unknown (country
    and code are null) where no code is known, as nothing can be said of its length.
    """
    text = F.trim(raw)
    digits = F.regexp_replace(text, "[^0-9]", "")
    abroad = text.startswith("+") | digits.startswith("00")
    number = F.when(abroad, F.regexp_replace(digits, "^0+", "")).otherwise(F.concat(F.lit(home), F.regexp_replace(digits, "^0+", "")))
    plans = F.create_map(*[x for code, (country, least, most) in NUMBERING_PLANS.items() for x in (F.lit(code), F.struct(F.lit(country).alias("country"), F.lit(code).alias("code"), F.lit(least).alias("least"), F.lit(most).alias("most")))])
    plan = F.coalesce(*[F.try_element_at(plans, F.substring(number, 1, n)) for n in (3, 2, 1)])
    national = F.when(plan.isNull(), number).otherwise(F.right(number, F.length(number) - F.length(plan["code"])))
    state = F.when(plan.isNull(), "unknown").when(F.length(national) < plan["least"], "too_short").when(F.length(national) > plan["most"], "too_long").otherwise("valid")
    return F.when(digits != "", F.struct(plan["country"].alias("country"), plan["code"].alias("code"), national.alias("national"), state.alias("state")))
