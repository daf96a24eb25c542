"""Patterns and word lists of the message rules."""

# The rules' patterns; results depend on them to the letter.
PROMOTIONS = {
    "discount": r"(?:discounts?|cashback|coupon|promo\s*code|\d+\s*%\s*(?:off|discount)"
    r"|\bflat\s*[*_~]*\s*(?:₹|rs\.?)\s*[\d,]+|[*_~]*\s*(?:₹|rs\.?)\s*[\d,]+\s*[*_~]*\s*off\b"
    r"|\bat just\b|\bstarting (?:at|from) (?:just|only)\b|\bupto\b|\bup to\s+\d+\s*%)",
    "upsell": r"\b(?:upgrade|upsell|cross.sell|premium plan|unlock (?:more|benefits|exclusive)|add.on)\b",
    "sales_cta": r"\b(?:buy now|shop now|book now|order now|call now|apply now|claim (?:your|the|now)"
    r"|grab (?:it|yours|now)|limited.time|exclusive offer|sale ends|hurry|last chance"
    r"|don'?t miss|miss out|know more|learn more|explore (?:our|more)|check it out"
    r"|sign up now|register now|enrol now|avail )",
    "reengagement": r"\b(?:abandoned cart|left (?:something|items) in your cart|we miss you|renew now"
    r"|explore our|new collection|special (?:offer|price|deal)|best (?:price|deal|rate)s?"
    r"|lowest price|for free|free trial|no cost|zero cost|guaranteed)\b",
    "gated_by_plan": r"(?:requires? (?:an? )?active [\w ]{0,20}\bplan\b|with an active [\w ]{0,20}\bplan\b"
    r"|\bplan (?:is )?required\b|subscribe to (?:access|unlock|continue)"
    r"|upgrade (?:to|your) [\w ]{0,20}\bplan\b|only (?:for|with) [\w ]{0,15}\bmembers?\b)",
    "lead_followup": r"(?:the (?:form|enquiry) you (?:filled|submitted)|regarding the ad\b"
    r"|interested in our (?:services?|products?|offerings?))",
}
AUTHENTICATION = r"\b(?:one.time (?:password|code)|verification code|your otp|authentication code)\b"
REFERENCE = r"\{\{[^}]+\}\}|\b\d{2,}\b"
TRANSACTION = (
    r"\b(?:invoice|bill(?:ing)?|payment|paid|refund|receipt|order|appointment|"
    r"booking|delivery|shipment|ticket|case|account|subscription|plan|policy|"
    r"agreement|contract|rent|tenant|landlord|owner|property|visit|inspection|"
    r"packer|mover|service|request|application|registration|verification|kyc|"
    r"biometric|document|reference|due|overdue|amount|balance|schedule[d]?|"
    r"reschedule[d]?|assigned|renewal|expir(?:y|es|ed|ing)|"
    r"loan|emi|instal?lment|statement|repayment)\b"
)
EVENTS = {
    "billing": r"\b(?:invoice|bill(?:ing)?|amount due|payment|paid|refund|receipt|due|overdue|balance|emi|deposit)\b",
    "order": r"\b(?:order|shipment|delivery|shipped|dispatched|pickup|packer|mover)\b",
    "appointment": r"\b(?:appointment|booking|reservation|visit|inspection|slot|schedule[d]?|reschedul\w+|demo)\b",
    "support": r"\b(?:ticket|case|support request|complaint|query|queries|issue|escalat\w+|resolv\w+)\b",
    "account": r"\b(?:account|profile|registration|verification|kyc|biometric|document|agreement|contract|subscription|plan|renewal|expir\w+|activat\w+|deactivat\w+|service interruption|outage)\b",
    "critical": r"\b(?:recall|safety alert|fraud|severe weather|evacuat\w*|urgent|action required)\b",
}
NEXT_PURCHASE = r"\bnext (?:order|purchase|booking)\b"
PLACEHOLDER = r"\{\{[^}]+\}\}"
QUESTION = r"[^.!?\n]*\?\s*"
CALL_TO_ACTION = (
    r"\b(?:call|click|tap|book|order|buy|shop|visit|apply|register|sign\s?up|subscribe|"
    r"claim|grab|hurry|explore|discover|check\s+out|don'?t\s+miss|avail|enroll)\b"
    r"[^.!?\n]*(?:now|today|here|below|link|us|online)\b[^.!?\n]*[.!?]?"
)
URGENCY = (
    r"\b(?:limited (?:time|period|offer)|last chance|hurry|ends (?:today|soon)|"
    r"only \d+ (?:days?|hours?) left|while stocks last)\b[^.!?\n]*[.!?]?"
)
COMPLETED = ["VERIFIED", "APPROVED", "ACTIVE"]
CATEGORIES = ["MARKETING", "UTILITY", "AUTHENTICATION"]
COMPONENTS = ["header", "body", "footer", "buttons"]
# First and last code points of scripts other than Latin.
SCRIPTS = {
    "Devanagari": (0x0900, 0x097F), "Bengali": (0x0980, 0x09FF), "Gurmukhi": (0x0A00, 0x0A7F), "Gujarati": (0x0A80, 0x0AFF), "Odia": (0x0B00, 0x0B7F),
    "Tamil": (0x0B80, 0x0BFF), "Telugu": (0x0C00, 0x0C7F), "Kannada": (0x0C80, 0x0CFF), "Malayalam": (0x0D00, 0x0D7F), "Arabic": (0x0600, 0x06FF),
}
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
LINK = r"https?://\S+"
LONG_NUMBER = r"(?<!\w)\+?\d[\d ()-]{7,}\d(?!\w)"
# End of fixed values.

#: One alternation over all promotional rules: a cheap test before the single ones.
ANY_PROMOTION = "|".join(f"(?:{p})" for p in PROMOTIONS.values())
