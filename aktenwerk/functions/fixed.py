"""Fixed values of the domain: laws, catalog, markers, placeholders, schemas. They must stay as they are for equal results."""

from __future__ import annotations

#: The laws that citations may name.
LAWS = ("BauGB", "BauNVO", "BImSchG", "BNatSchG", "EnWG", "VwGO", "WaStrG", "WHG", "WPG")

#: Catalog ids are the lower-cased laws; description heads.
CATALOG = {
    "baugb": "Baugesetzbuch (BauGB)",
    "baunvo": "Baunutzungsverordnung (BauNVO)",
    "bimschg": "Bundes-Immissionsschutzgesetz (BImSchG)",
    "bnatschg": "Bundesnaturschutzgesetz (BNatSchG)",
    "enwg": "Energiewirtschaftsgesetz (EnWG)",
    "vwgo": "Verwaltungsgerichtsordnung (VwGO)",
    "wastrg": "Bundeswasserstraßengesetz (WaStrG)",
    "whg": "Wasserhaushaltsgesetz (WHG)",
    "wpg": "Wärmeplanungsgesetz (WPG)",
}

#: Titles and functions in front of names.
NAME_PREFIXES = (
    "Dr.", "Prof.", "Dipl.-Ing. Akustik", "Dipl.-Ing.", "Dipl.-Wirtsch.-Ing.", "Rechtsanwalt", "Rechtsanwältin", "RA", "RAin",
    "Geschäftsführer", "Geschäftsführerin", "Sprecher", "Sprecherin", "den Vorsitzenden", "der Vorsitzende", "Vorsitzender", "Vorsitzende",
)
#: What marks a submitter as an organisation.
ORGANISATIONS = ("e.V.", "GmbH", "AöR", "PartGmbB", "Initiative", "Bürgerinitiative", "Stadtwerke", "Kanzlei", "Verband", "Verein")
#: Words of a name that aren't masked on their own.
NAME_STOPWORDS = ("und", "c/o", "familie", "von", "der", "die", "das")
#: Closing formulas, lower-cased.
CLOSINGS = (
    "mit freundlichen grüßen", "mit freundlichen gruessen", "mit freundlichem gruß", "mit freundlichem gruss", "freundliche grüße",
    "freundliche gruesse", "mit besten grüßen", "mit besten gruessen", "hochachtungsvoll", "gez.",
)
# A look at the first characters costs little and rules out most places (letters with and without a dot are an i here).
SUBMITTER = r"(?=[EeVvNn])(?=.[IiİıOoAa])(?iuU)(?:Einreichende Person|Einreichende Organisation|Einreicher|Von|Name)\s*:\s*"
REPRESENTATIVE = r"(?=[Vv])(?iuU)vertreten durch\s*:?\s*"
SIGNATURE_BLOCK, SIGNATURE_TAIL = 120, 250

#: Placeholders of masked regions.
PLACEHOLDERS = {"PERSON": "[NAME]", "PHONE_NUMBER": "[TELEFON]", "EMAIL_ADDRESS": "[EMAIL]", "IBAN_CODE": "[IBAN]"}
PHONE = r"(?=[+0])(?U)(?<![\d-])(?:\+49|0)[\s/-]?\d(?:[\s/-]?\d){6,}+"

#: What a custody chain's verification reports.
BREAKS = {
    "sequence": "sequence number is not monotonic", "no_hash": "event carries no chain hash", "version": "unknown serialization version",
    "genesis": "genesis event does not chain from the all-zero sentinel", "hash": "event hash does not match the recomputed hash", "digest": "a SHA-256 hex digest",
}

MAX_CHARS, SUBSTANCE_CHARS = 100_000, 500
GENESIS = "0" * 64
FENCE = {"<<<EINWENDUNG_START>>>": "<EINWENDUNG_START>", "<<<EINWENDUNG_ENDE>>>": "<EINWENDUNG_ENDE>"}

#: Keys and types of the payload of each event type; map<..> is a flat map.
PAYLOADS = {
    "eingang": {"document_id": "string", "masked_entity_counts": "map<int>"},
    "triage": {"argument_count": "int", "contradiction_detected": "bool", "substance_threshold_exceeded": "bool"},
    "retrieval": {"resolved_norm_count": "int"},
    "briefing_erstellt": {"entry_count": "int"},
    "kein_treffer": {"entry_count": "int"},
    "entwurf_unterdrueckt": {},
    "freigabe": {},
    "pipeline_fehler": {"reason": "string"},
    "startkonfiguration": {
        "git_sha": "string", "package_versions": "map<string>", "allowlist_size": "int", "tracing_enabled": "bool", "log_format": "string",
        "corpus_id": "string", "model_id": "string", "mistral_endpoint": "string",
    },
    "rohdokument_zugriff": {"document_id": "string"},
}

#: Upper bounds of the histogram of arguments, alert limits.
ARGUMENT_BOUNDS = (0, 1, 2, 3, 5, 8, 13, 21)
UNRESOLVED_LIMIT, VERIFICATION_LIMIT = 0.20, 0.10
