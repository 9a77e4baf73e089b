"""The registry of patterns and the static dimensions, as data.

A pattern is (id, type, priority, before, value, after, ignore_case): `value` is the span, `before` a label that
must precede it and `after` what must follow without being part of the match. Registry order breaks ties.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    id: str
    type: str
    priority: int
    value: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    tier: str = "core"

    @property
    def java(self) -> str:
        """For Spark: Unicode classes and boundaries, and only a line feed ends a line."""
        flags = "(?dUiu)" if self.ignore_case else "(?dU)"
        return f"{flags}({self.before})({self.value})" + (f"(?={self.after})" if self.after else "")


# Patterns, types and priorities -------------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_LINE_END = r"\n|\r|$"
_NAME = r"[A-ZÄÖÜ][a-zäöüß]{2,25}(?:\s+[A-ZÄÖÜ][a-zäöüß]{2,25}){0,2}"
_NUMBER_WORD = r"[\s\-]*(?:no\.?|nr\.?|number|nummer)?"
_SEP = r"\s*[:=\-]\s*"

PATTERNS: tuple[Pattern, ...] = (
    Pattern("r01_ch_ahv", "CH_AHV", 10, r"\b756\.\d{4}\.\d{4}\.\d{2}\b"),
    Pattern("r02_ch_ahv_spaced", "CH_AHV", 10, r"\b756[\s,]\d{4}[\s,]\d{4}[\s,]\d{2}\b"),
    Pattern("r03_iban_ch", "IBAN_CH", 10, r"\bCH\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{1}\b"),
    Pattern("r04_ch_access_code", "CH_ZUGANGSCODE", 9, r"\b[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}\b"),
    Pattern("r05_ch_postal", "CH_POSTAL", 5, r"\b[1-9]\d{3}", after=r"\s+[A-ZÄÖÜ][a-zäöüß]"),
    Pattern("r06_ch_id", "CH_ID_NUMBER", 9, r"\b\d{2}-\d{4}-\d{2}\b"),
    Pattern("r07_ch_reference", "CH_REFERENCE_ID", 9, r"\b\d{10,13}\b"),
    Pattern("r08_insurance", "INSURANCE_NUMBER", 9, r"\b\d{3}\s\d{3}\s\d{3}\b"),
    Pattern("r09_us_ssn", "US_SSN", 10, r"\b\d{3}-\d{2}-\d{4}\b"),
    Pattern("r10_uk_ni", "UK_NI", 9, r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]\b"),
    Pattern("r11_uk_postcode", "UK_POSTCODE", 5, r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", ignore_case=True),
    Pattern("r12_de_tax", "DE_STEUER_ID", 9, r"\b\d{11}\b"),
    Pattern("r13_fr_nir", "FR_NIR", 9, r"\b[12]\d{14}\b"),
    Pattern("r14_it_fiscal", "IT_CODICE_FISCALE", 9, r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", ignore_case=True),
    Pattern("r15_es_dni", "ES_DNI", 9, r"\b\d{8}[A-Z]\b"),
    Pattern("r16_es_nie", "ES_NIE", 9, r"\b[XYZ]\d{7}[A-Z]\b", ignore_case=True),
    Pattern("r17_passport", "ICAO_PASSPORT", 9, r"\b[A-Z]{2}\d{6,9}\b"),
    Pattern("r18_email", "EMAIL", 9, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"),
    Pattern("r19_phone", "PHONE_INTL", 8, r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{2,4}[\s\-]?\d{2,4}[\s\-]?\d{0,4}\b"),
    Pattern("r20_iban", "IBAN_INTL", 10, r"\b[A-Z]{2}\d{2}\s?[\dA-Z]{4}(?:\s?[\dA-Z]{4}){2,7}(?:\s?[\dA-Z]{1,4})?\b"),
    Pattern("r21_card", "CREDIT_CARD", 10, r"\b(?:\d[\s\-]?){13,19}\b"),
    Pattern("r22_ip", "IP_ADDRESS", 8, rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b"),
    Pattern("r23_date_dmy", "DATE_OF_BIRTH", 3, r"\b(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.\d{4}\b"),
    Pattern("r24_date_ymd", "DATE_OF_BIRTH", 3, r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    Pattern("r25_person", "PERSON", 7, _NAME, rf"(?:name|patient|holder|insured|versicherte[rn]?|assur[eé]e?|empfänger|inhaber|beneficiary|claimant){_SEP}", "", True, "label"),
    Pattern("r26_doctor", "PERSON", 7, _NAME, rf"(?:physician|doctor|arzt|ärztin|médecin|dottore){_SEP}", "", True, "label"),
    Pattern("r27_policy", "INSURANCE_NUMBER", 7, r"[A-Z0-9][\w.\-\s]{2,20}", rf"(?:insurance|versicherungs?|police|policy|assurance){_NUMBER_WORD}{_SEP}", "", True, "label"),
    Pattern("r28_birth", "DATE_OF_BIRTH", 7, r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}", rf"(?:date\s+of\s+birth|d\.?\s*o\.?\s*b\.?|geburtsdatum|date\s+de\s+naissance|data\s+di\s+nascita|geboren){_SEP}", "", True, "label"),
    Pattern("r29_id", "ID_NUMBER", 7, r"[A-Z0-9][\w\-]{4,15}", rf"(?:passport|ausweis|reisepass|carta\s+d'identit[àa]|identity\s+card|personalausweis){_NUMBER_WORD}{_SEP}", "", True, "label"),
    Pattern("r30_address", "ADDRESS", 7, r".{5,80}?", rf"(?:address|adresse|anschrift|wohnort|domicile|indirizzo){_SEP}", _LINE_END, True, "label"),
    Pattern("r31_icd", "ICD_CODE", 2, r"\b[A-TV-Z]\d{2}(?:\.\d{1,2})?\b", tier="health"),
    Pattern("r32_diagnosis", "HEALTH_DATA", 7, r".{3,60}?", rf"(?:diagnosis|diagnose|diagnostic){_SEP}", _LINE_END, True, "health"),
    Pattern("r33_medication", "HEALTH_DATA", 7, r".{3,80}?", rf"(?:medications?|medikamente?|médicaments?|current\s+treatment){_SEP}", _LINE_END, True, "health"),
    Pattern("r34_allergy", "HEALTH_DATA", 7, r".{3,60}?", rf"(?:allergies?|allergi(?:en|es?)){_SEP}", _LINE_END, True, "health"),
    Pattern("r35_blood_type", "HEALTH_DATA", 7, r"[ABO]{1,2}[+\-]", r"(?:blood\s+(?:type|group)|blutgruppe|groupe\s+sanguin)\s*[:=\-]?\s*", "", True, "health"),
)
#: Lower-case words of which every match of a label pattern holds one.
STEMS = {
    "r25_person": ("name", "patient", "holder", "insured", "versicherte", "assur", "empfänger", "inhaber", "beneficiary", "claimant"),
    "r26_doctor": ("physician", "doctor", "arzt", "ärztin", "médecin", "dottore"),
    "r27_policy": ("insurance", "versicherung", "police", "policy", "assurance"),
    "r29_id": ("passport", "ausweis", "reisepass", "carta", "identity"),
    "r30_address": ("address", "adresse", "anschrift", "wohnort", "domicile", "indirizzo"),
    "r32_diagnosis": ("diagnos",),
    "r33_medication": ("medication", "medikament", "médicament", "treatment"),
    "r34_allergy": ("allerg",),
    "r35_blood_type": ("blood", "blutgruppe", "sanguin"),
}
#: Least length of a stripped value, by tier; core matches are not stripped.
LEAST_LENGTH = {"core": 0, "label": 3, "health": 2}

# Types and their ranks ----------------------------------------------------------------------
CRITICAL_TYPES = ("CH_AHV", "US_SSN", "IBAN_CH", "IBAN_INTL", "CREDIT_CARD")
MODERATE_TYPES = ("PERSON", "LOCATION", "ADDRESS", "EMAIL", "PHONE_INTL", "PHONE_NUMBER")
NEVER_DISPUTED = ("PERSON", "DATE_OF_BIRTH", "CH_AHV", "US_SSN", "IBAN_CH", "IBAN_INTL", "CREDIT_CARD")
ALWAYS_PROTECTED = ("CH_AHV", "IBAN_CH", "IBAN_INTL", "US_SSN", "EMAIL_ADDRESS", "EMAIL", "CREDIT_CARD")
NER_LABELS = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION", "DATE": "DATE_TIME"}
NER_PRIORITIES = {
    "PERSON": 6, "LOCATION": 5, "ADDRESS": 5, "ORGANIZATION": 4, "DATE_TIME": 3, "DATE_OF_BIRTH": 3, "PHONE_NUMBER": 8,
    "EMAIL_ADDRESS": 9, "IBAN_CODE": 10, "CREDIT_CARD": 10, "US_SSN": 10, "CH_AHV": 10, "HEALTH_DATA": 2, "ICD_CODE": 2,
}
NER_PRIORITY = 5
TYPE_FLOORS = {
    "PERSON": 0.80, "DATE_OF_BIRTH": 0.85, "EMAIL_ADDRESS": 0.95, "EMAIL": 0.95, "PHONE_NUMBER": 0.80, "PHONE_INTL": 0.80,
    "LOCATION": 0.60, "ORGANIZATION": 0.55, "ORG": 0.55,
}
TYPE_FLOOR = 0.50
SYNTHETIC = {
    "PERSON": "John Doe", "EMAIL_ADDRESS": "redacted@example.com", "PHONE_NUMBER": "+1-000-000-0000", "LOCATION": "123 Redacted St",
    "IBAN_CODE": "XX00 0000 0000 0000", "CREDIT_CARD": "0000-0000-0000-0000", "DATE_TIME": "01/01/2000", "IP_ADDRESS": "0.0.0.0",
    "US_SSN": "000-00-0000", "US_BANK_NUMBER": "000000000", "US_DRIVER_LICENSE": "X0000000", "US_PASSPORT": "000000000",
}
TYPE_LABELS = {
    "CH_AHV": "AHV number", "US_SSN": "SSN", "IBAN_CH": "Swiss IBAN", "IBAN_INTL": "IBAN", "CREDIT_CARD": "credit card number",
    "PERSON": "name", "LOCATION": "location", "ADDRESS": "address", "EMAIL": "email address", "PHONE_INTL": "phone number",
    "PHONE_NUMBER": "phone number", "DATE_OF_BIRTH": "date of birth", "DATE_TIME": "date", "INSURANCE_NUMBER": "insurance number",
    "CH_ZUGANGSCODE": "access code", "CH_ID_NUMBER": "ID number", "CH_POSTAL": "postal code", "ORGANIZATION": "organisation", "IP_ADDRESS": "IP address",
}

# Context words -------------------------------------------------------------------------------
COUNTRIES = ("switzerland", "schweiz", "suisse", "svizzera", "germany", "france", "europe", "europa", "international", "worldwide")
SCOPE_WORDS = ("anywhere in", "throughout", "available in", "ward", "coverage", "valid in", "gültig in", "valable en", "service in", "protection")
LEGEND_WORDS = ("abbreviation", "abkürzung", "general insurance", "additional insurance", "federal law", "conditions")
REGION_WORDS = ("premium region", "prämienregion", "region")
CONFIDENCE_WORDS = (
    "insurance no", "policyholder", "date of birth", "geboren", "versicherte", "assuré", "policy", "mr", "mrs", "ms", "herr", "frau",
    "insured", "customer", "client",
)
STREET_WORDS = ("strasse", "straße", "str.", "gasse", "weg", "allee", "platz", "boulevard", "avenue", "road", "street", "lane", "rue", "via")
DOC_TYPES = ("insurance", "medical", "police", "tax", "government", "general")
CONTENT_TAGS = ("<document_content>", "</document_content>")

# Modes and limits ----------------------------------------------------------------------------
APPROACHES = ("redact", "replace", "mask", "hash", "encrypt", "highlight", "synthesize")
PAGE_CAP, UPLOAD_CAP = 500, 50 * 1024 * 1024
WINDOW_TOKENS, OVERLAP_TOKENS, NER_THRESHOLD = 460, 50, 0.35
BATCH_CHARS, PAGE_CHARS, CLASSIFY_CHARS = 8000, 5000, 2000
PBKDF2_ROUNDS, SALT_BYTES, NONCE_BYTES, KEY_BYTES = 480_000, 16, 12, 32
