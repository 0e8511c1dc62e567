"""Rule packs and limits: everything about a domain that is data, not logic."""

from __future__ import annotations

from dataclasses import dataclass, field

#: File extensions of the inventory's profile, and of the survey's.
SUPPORTED = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".jpg", ".jpeg", ".tif", ".tiff", ".eml", ".hwp", ".hwpx")
EXCLUDED = (".png", ".html")
SURVEY_SUPPORTED = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".jpg", ".jpeg", ".tif", ".tiff", ".xlsx", ".xls", ".eml")
IMAGES = (".jpg", ".jpeg", ".tif", ".tiff")

#: What a survey assumes for a supported file.
SECONDS_PER_FILE, USD_PER_FILE = 3.5, 0.0029

#: Columns of the metadata extension.
LEGAL_KEYS = [
    "case_name_normalized", "case_alias", "case_type", "dispute_type", "document_category", "document_type_normalized",
    "procedure_stage", "document_purpose", "legal_issue_primary", "legal_issue_secondary", "issue_tags", "claim_type",
    "party_our_side", "party_counterparty", "party_role", "law_firm_name_normalized", "institution_role", "country_region",
    "amount_mentioned", "claim_amount", "currency", "amount_context", "event_date", "date_type", "next_action_date",
    "timeline_summary", "lawyer_summary", "search_summary", "recommended_use", "review_priority", "review_priority_reason",
    "metadata_limitations", "needs_legal_review",
]


@dataclass(frozen=True)
class RulePack:
    """Words and patterns of a language or domain.  Patterns are Java regular expressions."""

    org_name: str = "ORG"
    default_title: str = "Document"
    default_type: str = "Other"
    letters: str = "A-Za-z"
    excluded_folder: str = r"^\s*4\s*[.\-]?\s*cat"
    doc_types: tuple[str, ...] = ("Statement of Claim", "Settlement Agreement", "Power of Attorney", "Agreement", "Contract", "Notice", "Opinion", "Invoice", "Memo", "Report")
    institutions: tuple[str, ...] = ()
    titles: tuple[tuple[str, str], ...] = (("Statement of Claim", "Claim"), ("Settlement Agreement", "Settlement"), ("Power of Attorney", "Proxy"), ("Legal Notice", "Notice"), ("Memo", "Memo"))
    vague_titles: tuple[str, ...] = ("document", "related", "file", "other")
    company_words: tuple[str, ...] = ("international", "corporation", "company", "limited", "llc", "ltd", "inc", "corp")
    generic_summaries: tuple[str, ...] = ("correspondence about the matter", "document sent for information", "notes of a meeting")
    #: Revision marks in order of preference.
    revisions: tuple[str, ...] = (r"(?i)(rev(?:ision)?\.?\s*\d+)", r"(?i)(ver(?:sion)?\.?\s*\d+|v\.?\s*\d+)", r"(?i)(?<![A-Za-z])(final|draft|rev(?:ision)?)(?![A-Za-z])")
    #: Sentences that say nothing.
    boilerplate: tuple[str, ...] = (
        r"(?i)^(dear|best regards|regards|sincerely|to whom it may concern)\b",
        r"(?i)^(from|to|cc|bcc|subject|sent)\b",
        r"(?i)any form of notice[, ]+copy",
        r"(?i)copying or distribu",
        r"(?i)without prior written consent",
        r"(?i)all rights reserved",
    )
    summary_words: str = r"(?i)(agreement|contract|report|decision|notice|invoice|claim)"
    structure_words: str = r"(?i)\b(this|these|agreement|contract|report)\b"
    low_value_summary: str = r"(?i)\b(please find|for your reference|kind regards|thank you|phone|fax)\b"
    low_value_words: tuple[str, ...] = ("however", "therefore", "regarding", "attached", "please", "thanks", "hello")
    keyword_noise: str = r"(?i)^(page\s*\d+|hello\s+\w+|attached|no\.?)$"
    keyword_positive: str = r"(?i)(agreement|contract|report|decision|notice|invoice|claim|certificate|memo)"
    keyword_useful: str = r"(agreement|contract|report|decision|notice|invoice|claim|certificate|payment)"
    mail_words: str = r"(?i)(kind regards|please find|thank you|from:|to:|subject:)"
    yes: str = "Y"
    no: str = "N"


NEUTRAL = RulePack()

#: The Korean pack.  Names of firms and people are the user's configuration.
KOREAN = RulePack(
    org_name="법무실",
    default_title="문서",
    default_type="기타",
    letters="A-Za-z가-힣",
    excluded_folder=r"^\s*4\s*[.\-]?\s*기타\s*문서",
    doc_types=("소송진행현황", "진행현황", "소송진행", "소송진행보고", "심리결과보고", "법원명령", "상대방서면", "증거서류", "법률의견", "계약서", "통지서", "주주간계약서", "소장", "답변서", "준비서면", "의견서", "보고서", "안내문", "안내", "중재신청서", "중재판정문", "Partial Award", "Request for Arbitration", "Power of Attorney", "Retainer Agreement", "Settlement Agreement", "Statement of Claim", "witness statement", "Legal Notice", "Demand Letter", "Invoice", "Memo", "위임장", "품의서", "레터"),
    titles=(("소송진행현황", "소송진행보고"), ("진행현황", "소송진행보고"), ("소송진행", "소송진행보고"), ("소장", "소장"), ("답변서", "답변서"), ("준비서면", "준비서면"), ("판결", "판결"), ("검토의견서", "검토의견서"), ("내부보고서", "내부보고"), ("합의서", "합의서"), ("진술서", "진술서"), ("심리결과보고", "심리결과보고"), ("법원명령", "법원명령"), ("상대방서면", "상대방서면"), ("증거서류", "증거서류"), ("법률의견", "법률의견"), ("통지서", "통지서"), ("계약서", "계약서"), ("의견서", "의견서"), ("보고서", "보고"), ("중재신청서", "중재신청"), ("중재판정문", "중재판정"), ("위임장", "위임장"), ("품의서", "품의"), ("양해각서", "양해각서"), ("안내문", "안내문"), ("안내", "안내문"), ("Legal Notice", "법률통지"), ("Demand Letter", "청구통지"), ("Memo", "메모"), ("Power of Attorney", "위임장"), ("Statement of Claim", "청구서"), ("witness statement", "증인진술")),
    vague_titles=("관련문서", "관련자료", "문서", "자료", "파일", "document", "related", "기타"),
    revisions=(NEUTRAL.revisions[0], NEUTRAL.revisions[1], r"(최종본|최종)", r"(수정본\d*|수정\d*)", NEUTRAL.revisions[2]),
    boilerplate=(*NEUTRAL.boilerplate[:2], r"(?U)^(첨부|안녕하세요|감사합니다|수신|참조)\b", *NEUTRAL.boilerplate[2:]),
    summary_words=r"(?i)(agreement|contract|arbitration|claim|notice|opinion|invoice|memo|판결|중재|소송|계약|합의|의견|보고)",
    generic_summaries=("preliminary land sale agreement terms", "preliminary sale agreement for land", "land sale contract between two parties"),
    structure_words=r"(?i)\b(this|agreement|contract|claim|arbitration)\b",
    low_value_summary=r"(?i)\b(this is for your information|with reference to the above|telephone number|tel\.?|fax|dear|best regards|sincerely|subject matter claim|with reference|for your information)\b",
    low_value_words=("however", "dear", "reference", "hereinafter", "thereof", "therein", "subject", "information", "update", "telephone", "number", "regards"),
    keyword_noise=r"(?i)^(page\s*\d+|dear\s+(mr|ms)\.?|however|comm|com|reference\s*no\.?|subject(\s+matter)?)$",
    keyword_positive=r"(?i)(legal\s*notice|notice|attachment|arbitration|claim|contract|agreement|mou|term\s*sheet|sale|ownership|certificate|land\s*sale|passport|memo)",
    keyword_useful=r"(agreement|contract|claim|notice|arbitration|opinion|certificate|payment|litigation|counsel|hearing|dissolution|indemnity|guarantee|standstill|attachment|consolidation)",
    mail_words=r"(?i)(dear|best regards|sincerely|from:|to:|subject:)",
)


@dataclass(frozen=True)
class Settings:
    """Limits of the engine."""

    supported: tuple[str, ...] = SUPPORTED
    excluded: tuple[str, ...] = EXCLUDED
    confidence_threshold: float = 0.78
    default_confidence: float = 0.72
    max_filename_length: int = 180
    path_length_limit: int = 240
    excerpt_chars: int = 8000
    force_ocr_chars: int = 80
    keyword_confidence: float = 75.0
    batch_size: int = 20
    attempts: int = 3
    rules: RulePack = field(default_factory=RulePack)


def load_settings(path: str) -> Settings:
    """Settings from a YAML or JSON file with the same names; YAML needs the yaml package."""
    import json
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    rules = RulePack(**{k: tuple(map(tuple, v)) if k == "titles" else tuple(v) if isinstance(v, list) else v for k, v in given.pop("rules", {}).items()})
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}, rules=rules)
