"""Named queries of the sentence harvesters: frame tables in English and French over all paragraphs and list items.

A frame is a pattern with the patterns it needs and excludes, a base score in
hundredths, signals that add to it and caps that hold it down. All frames of a
query are one array expression, so a sentence is looked at once; there is no
join and no shuffle. Blocks labelled French are read by the French frames, all
others by the English ones. Beside the blocks, each query reads a few sentences
that hold every frame's case, written the same way in the SQL.

Patterns look at the sentence in lower case with plain apostrophes; patterns of
names look at it as it stands.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.plans.common import fixture, values
from lexmill.plans.mining import _SPLIT_SQL, _split
from lexmill.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def W(body: str) -> str:
    """The words, not as parts of longer ones."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{body})(?:$|[^\p{{L}}\p{{N}}_])"


class Harvest(NamedTuple):
    op: str
    lang: str
    field: str
    frame: str
    base: int
    pattern: str
    needs: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    #: (weight, pattern); a pattern that begins with "heading:" looks at the headings above.
    signals: tuple[tuple[int, str], ...] = ()
    #: (cap, patterns that must fit, patterns that must not)
    caps: tuple[tuple[int, tuple[str, ...], tuple[str, ...]], ...] = ()


class Named(NamedTuple):
    op: str
    lang: str
    field: str
    frame: str
    base: int
    #: One group, the name; looks at the sentence as it stands.
    name: str
    needs: tuple[str, ...] = ()
    role: str = ""


_D = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4}"
_DF = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:1er|[0-9]{1,2}) (?:janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre) [0-9]{4}"
# Words of action, money, deadlines and payment in both languages.
ACTION = {
    "en": W(r"deliver|provide|furnish|make available|submit|file|send|notify|pay|reimburse|fund|deposit|remit|wire|transfer|maintain|keep|preserve|retain|obtain|perform|comply|execute|cause|procure|ensure|approve|consent|waive|terminate|cure|remedy"),
    "fr": W(r"livrer?|fourni[rt]?|remettre|remet|remis|mettre à (?:la )?disposition|soumettre|soumet|soumis|dépose[r]?|déposé|envoye[r]|envoie|transmettre|transmet|avise[r]?|notifie[r]?|paye[r]|paie|verse[r]?|rembourse[r]?|finance[r]?|vire[r]?|transférer|transfère|maintenir|maintient|conserve[r]?|préserve[r]?|obtenir|obtient|exécute[r]?|respecte[r]?|se conformer|faire en sorte|veiller à|approuve[r]?|consentir|consent|renonce[r]?|résilie[r]?|remédie[r]?|corrige[r]?"),
}
MONEY = {"en": r"\$ ?[0-9,]+(?:\.[0-9]{2})?|(?:^|[^\p{L}\p{N}_])(?:usd ?[0-9,]+|purchase price|fee|expense|escrow amount|holdback)", "fr": r"[0-9]{1,3}(?:[ \x{A0}\x{202F}][0-9]{3})*(?:,[0-9]+)? ?m?\$"}
DEADLINE = {"en": W(r"by|within|before|after|following|prior to|no later than|not later than|on or before|promptly after|as soon as practicable|cure period|written notice|" + _D), "fr": W(r"avant|après|dans les?|au plus tard|préavis|délai|" + _DF)}
PAYMENT = {"en": W(r"pay|reimburse|fund|deposit|remit|wire|transfer|payable|due and payable"), "fr": W(r"paie(?:nt|ra)?|payer|payée?|verse(?:nt|ra)?|verser|versée?|rembourse(?:nt|ra|r)?|remboursée?|finance(?:nt|ra|r)?|dépose(?:nt|ra|r)?|remet(?:tent|tra|tre)?|vire(?:nt|ra|r)?|transfère(?:nt)?|transférer|payable|exigible|à titre de contrepartie")}
# Wording that weakens a candidate, seven hundredths each.
ANTI = {"including_example": W(r"including(?: without limitation)?|for example") + r"|(?:^|[^\p{L}])e\.g\.", "descriptive_may": W(r"may (?:include|contain|consist)"), "generic_affiliate": r"^ *affiliates? *$", "generic_qualifier": r"^ *(?:material|reasonable) *$"}
# Headings under which a field is expected.
PRIORS = {
    "obligations": r"obligations?|covenants?|deliver(?:y|ies)|notices?|reporting|closing", "conditions": r"conditions?|closing|precedent|dependency|deliver(?:y|ies)", "deadlines": r"deadlines?|timeline|schedule|closing|notices?|cure", "documents": r"documents?|deliver(?:y|ies)|certificates?|filings?|records?|schedules?|exhibits?",
    "transfers": r"payment|funds?|waterfall|purchase price|escrow|holdback|expense", "communications": r"notices?|communications?|delivery method", "controls": r"controls?|audit|evidence|verified|review|approv|sign-?off|compliance", "relationships": r"ownership|control|authority|governance|affiliate|assignment",
}


def _prior(field: str) -> tuple[int, str]:
    return 5, "heading:" + PRIORS[field]


_MAY = W("may")
_CORP = r"(?:Inc\.?|LLC|Ltd\.?|Ltée\.?|Corp(?:oration)?\.?|Company|LLP|LP|PLC|plc|GmbH|S\.E\.N\.C\.|S\.A\.R\.L\.?|S\.A\.|SARL|SAS)"
_NAME = r"((?:[A-ZÀ-ÖØ-Þ][\p{L}\p{N}.&'-]*,? ){1,6}" + _CORP + ")"
_SUBJECT = r"^(?:The |Le |La |Les )?([A-ZÀ-Þ][\p{L}\p{N} .&'/-]{1,80}?) (?:shall|must|will|agrees?|undertakes|covenants|is required|is obligated|is responsible|may|notify|deliver|provide|pay|reimburse|fund|transfer|remit|wire|doit|doivent|s'engage)(?:[^\p{L}]|$)"
_CORROB = W(r"shall|must|agrees?|required|obligated|pay|payment|closing|consent|deliver|certificate|notice|deadline|within|by")


def _both(op: str, field: str, rows: tuple[tuple[str, int, str, str], ...], signals=lambda lang: (), caps=lambda lang, frame: ()) -> list[Harvest]:
    return [Harvest(op, lang, field, frame, base, W(p), signals=signals(lang), caps=caps(lang, frame)) for frame, base, en, fr in rows for lang, p in (("en", en), ("fr", fr))]


# Frames with their base scores and wording.
OBLIGATIONS = (
    ("negative_obligation", 78, r"shall not|will not|agrees? not to|is prohibited from|may not|must not|no party shall", r"ne (?:doit|doivent|devra|devront|peut|peuvent) pas|s'engage(?:nt)? à ne pas|il est interdit de|s'abstien(?:t|nent) de|aucune partie ne (?:doit|peut)"),
    ("best_efforts_duty", 76, r"use commercially reasonable efforts|reasonable best efforts|best efforts|good faith efforts", r"efforts commercialement raisonnables|meilleurs efforts|efforts raisonnables|de bonne foi"),
    ("procurement_duty", 80, r"shall cause|shall procure that|shall ensure that|cause its affiliates to", r"fai(?:t|re|ra) en sorte que|veille(?:nt|ra)? à ce que|s'assure(?:nt)? que"),
    ("continuing_duty", 68, r"continue to|maintain|keep|preserve|retain|not permit", r"continue(?:nt|ra)? (?:à|de)|maintien(?:t|nent)|conserve(?:nt)?|préserve(?:nt)?|ne permet(?:tent)? pas"),
    ("positive_obligation", 70, r"shall|must|agrees? to|undertakes to|covenants to|will|(?:is|are) obligated to|(?:is|are) responsible for|(?:is|are) required to", r"doit|doivent|devra|devront|s'engage(?:nt)? à|est tenue? de|sont tenue?s de|il incombe à|a l'obligation de|est responsable de|est obligée? de"),
)
CONDITIONS = (
    ("condition_precedent", 66, r"condition precedent|subject to the satisfaction of|subject to waiver of|unless and until|provided that", r"condition préalable|sous réserve de la (?:réalisation|satisfaction) de|sous réserve de la renonciation à|à condition que|pourvu que"),
    ("trigger_condition", 42, r"if|in the event that|upon|following|after receipt of|once|where", r"si|advenant que|dans le cas où|en cas de|dès (?:que|réception)|lorsque|sur réception de|une fois que|où"),
    ("exception_carveout", 48, r"except that|except as|other than|excluding|provided however|notwithstanding|for the avoidance of doubt|nothing herein shall", r"sauf (?:que|si|disposition contraire)|à l'exception de|à l'exclusion de|autre que|excluant|nonobstant|malgré|pour éviter toute ambiguïté|rien dans les présentes"),
    ("dependency", 44, r"conditioned upon|dependent on|contingent upon|subject to", r"conditionnée? (?:à|par)|dépend(?:ent)? de|subordonnée? à|sous réserve de"),
)
DEADLINES = (
    ("hard_deadline", 64, r"no later than|on or before|not later than|at least [0-9]+ (?:business )?days? before|by (?:the )?closing(?: date)?|by (?:" + _D + ")", r"au plus tard (?:le|à)|au moins [0-9]+ jours? (?:ouvrables )?avant|d'ici le|avant le (?:" + _DF + ")"),
    ("relative_deadline", 58, r"within [0-9]+ (?:business |calendar )?days? (?:after|of|from)|(?:shall have|have|has) [0-9]+ (?:business |calendar )?days? (?:after|to|from|following)|promptly after|as soon as practicable after", r"dans les? [0-9]+ (?:jours? (?:ouvrables )?|mois |semaines? )(?:suivant|après|de)|promptement après|dès que (?:possible|raisonnablement possible) après"),
    ("pre_closing_deadline", 62, r"prior to closing|before the closing date|at or before closing", r"avant la clôture|avant la date de clôture|à la clôture ou avant"),
    ("post_closing_deadline", 62, r"after the closing date|post-closing|from and after closing", r"après la clôture|après la date de clôture|suivant la clôture|suivant la date de clôture|postérieurement à la clôture"),
    ("notice_period", 66, r"(?:upon )?[0-9]+ (?:business )?days?'? (?:prior )?written notice", r"(?:moyennant un )?préavis (?:écrit )?de [0-9]+ jours?"),
    ("cure_period", 66, r"cure period|fails? to cure within|remedied within", r"délai de remédiation|omet de remédier dans|défaut de remédier dans|corrigée? dans un délai de"),
)
CONSENT = (
    ("consent_given", 60, r"consents? to|expressly consents?|hereby consents?|consented to", r"consent(?:ent)? (?:expressément )?à|consent par les présentes à|a consenti à|donne(?:nt)? (?:son|leur) consentement à"),
    ("consent_required", 64, r"requires? consent|with the prior written consent of|without consent|subject to approval", r"exige le consentement|avec le consentement préalable écrit de|consentement préalable écrit|sans le consentement|sous réserve de l'approbation"),
    ("approval_right", 72, r"approval shall not be unreasonably (?:withheld|conditioned|delayed)", r"approbation ne (?:peut|doit|sera|pourra) (?:pas )?être (?:refusée|retenue|retardée)"),
    ("sole_discretion", 58, r"in its sole discretion|absolute discretion|reasonable discretion", r"à sa (?:seule|entière) discrétion|discrétion absolue|discrétion raisonnable"),
    ("veto_right", 66, r"may block|may object|right to object|shall not proceed without", r"peu(?:t|vent) bloquer|peu(?:t|vent) s'opposer|droit de s'opposer|ne procède(?:nt)? pas sans"),
    ("waiver", 64, r"may waive|waiver of|waived by|failure to enforce shall not constitute waiver", r"peu(?:t|vent) renoncer|renonciation à|renoncée? par"),
)
# Wording of the frames that stand alone.
_SCHEDULE = W(r"schedule(?: no\.?)? *[a-z0-9]+|exhibit [a-z0-9]+|annexe? *[0-9]+|set forth on schedule|disclosed on schedule")
_REP = W(r"represents and warrants|representations?|warranties|true and correct|to the knowledge of|except as disclosed|set forth on schedule")
_DOC_EN = r"deliver|provide|furnish|make available|submit|file|send|officer's certificate|secretary's certificate|bring-down certificate|compliance certificate|executed counterpart|books and records|inspection rights|schedule no\.? *[0-9]+|schedule [a-z0-9]+|exhibit [a-z0-9]+|annexe? [0-9]+|set forth on schedule|disclosed on schedule"
_DOC_FR = r"livre(?:r|nt)?|fourni(?:r|t|ssent)?|remet(?:tre|tent)?|met(?:tre)? à (?:la )?disposition|soumet(?:tre|tent)?|dépose(?:r|nt)?|transmet(?:tre|tent)?|pièce|annexe|convention|entente|certificat de (?:dirigeant|conformité)|exemplaire signé|livres et registres|droit d'inspection"
_DOC_NAME = W(r"schedule(?: no\.?)? [0-9]+(?:\.[0-9]+)*|exhibit [a-z0-9]+|annexe? (?:no\.? *)?[0-9]+|officer's certificate|secretary's certificate|bring-down certificate|compliance certificate|executed counterpart|books and records|certificat de (?:dirigeant|conformité)|exemplaire signé|livres et registres|(?:\p{L}+ ){1,6}(?:agreement|contract|deed|certificate|licence|license|policy|plan|report|statement|order|opinion|release|amendment|waiver)")
_NOTICE = {
    "en": W(r"notify|give notice|written notice|notice shall be sent|to the attention of|with a copy to|cc|email|overnight courier|certified mail|personal delivery|deemed (?:received|given)|effective upon receipt"),
    "fr": W(r"aviser|avise(?:nt|ra)?|donner (?:un )?avis|avis écrit|mise en demeure|signification|signifier|signifiée?|à l'attention de|avec copie à|courriel|courrier recommandé|messagerie de nuit|remise en mains? propres|réputée? (?:reçue?|donnée?)"),
}
_METHOD = W(r"email|overnight courier|certified mail|personal delivery|courriel|courrier recommandé|messagerie de nuit|remise en mains? propres")
_SENDER = r"(?:^|[^\p{L}])\p{L}[\p{L} .&']+? (?:shall |must |will )?(?:notify|give notice to|send notice to) "
_RECIPIENT = r"(?:notify|give notice to|send notice to|notice shall be sent to|aviser?) (?:the |le |la |les )?\p{L}+"
_REMEDY = {
    "en": W(r"breach|default|event of default|failure to perform|non-compliance|cure|remedy|fails? to cure|may terminate|right to terminate|termination event|automatic termination|specific performance|injunctive relief|damages|indemnification|setoff|survive (?:closing|termination)|remain in effect"),
    "fr": W(r"violation|manquement|défaut|cas de défaut|inexécution|non-conformité|remédier|remédiation|peu(?:t|vent) résilier|droit de résilier|résiliation|résolution|exécution en nature|injonction|dommages-intérêts|indemnisation|compensation|survi(?:t|vent) à|demeure(?:nt)? en vigueur"),
}
_CONTROL = {
    "en": (W(r"verified by|evidenced by|control(?:led)? by|audit(?:ed)? (?:by|via)|reviewed by|approved by|sign-?off"), W(r"verified by|evidenced by|audit(?:ed)?")),
    "fr": (W(r"vérifiée?s? par|attestée?s? par|contrôlée?s? par|sous le contrôle de|auditée?s? par|vérification (?:par|de)|examinée?s? par|approuvée?s? par|mesure de protection|chiffrement|contrôle"), W(r"vérifiée?s?|attestée?s?|auditée?s?|vérification|chiffrement")),
}
_SECURITY = W(r"encrypt(?:ed|ion|ing)|aes-256|tls *[0-9]|role-based access|multi-factor auth(?:entication)?|mfa|access control|authentication|authorization|penetration test(?:ing)?|incident response plan|breach notification|confidentiality agreement|non-disclosure agreement|nda|privacy training|security training|data (?:protection|security|masking|minimisation|minimization)|pseudonymis(?:ed|ation)|anonymis(?:ed|ation)|security (?:control|measure|safeguard|assessment)|vulnerability scan(?:ning)?")
_SECURITY_HEADING = W(r"security|safeguards?|controls?|technical|organisational|organizational|privacy|data protection|encryption|access management")
_DATAFLOW = r"^\*\*[^*]*(?:inc\.?|ltd\.?|corp\.?|llc)\*\* *:|(?:data|information) is (?:transferred|sent|transmitted) (?:via|to|through)|receives? (?:\p{L}+ ){0,3}(?:data|information) for"
_AUTHORITY = {
    "en": W(r"controls|controlled by|under common control|power to direct|authorized to|has authority to|power and authority|duly authorized|may not assign|transfer|pledge|encumber|dispose of|board approval|manager approval|shareholder approval|consent of members"),
    "fr": W(r"contrôle|contrôlée? par|sous contrôle commun|filiale en propriété exclusive|actionnaires?|pouvoir de diriger|autorisée? à|a le pouvoir de|pouvoir et autorité|dûment autorisée?|ne peu(?:t|vent) (?:pas )?céder|transférer|nantir|grever|aliéner|approbation du conseil"),
}
_OCCURRED = {
    "en": W(r"heard|filed|issued|entered into|rendered|released|decided|dismissed|granted|allowed|denied|dated|executed|signed|served|commenced|convened|adjourned|occurred|took place|closed|pronounced|sentenced|convicted|acquitted|registered|incorporated|amalgamated|notified|approved"),
    "fr": W(r"entendue?|déposée?|rendue?|signifiée?|conclue?|survenue?|publiée?|décidée?|rejetée?|accueillie?|accordée?|refusée?|datée?|signée?|exécutée?|intentée?|introduite?|eu lieu|prononcée?|condamnée?|acquittée?|enregistrée?|constituée?|approuvée?|clôturée?|entrée? en vigueur"),
}
_HYPOTHETICAL = W(r"shall|will|must|should|if|in the event|subject to|provided that|once|when|to be")
_CONTINGENT = r"^(?:advenant|in the event (?:of|that)|en cas de|upon (?:a breach|default|insolvency|failure))(?:[^\p{L}]|$)"
_LEAD_IN = W(r"(?:shall|must|will) (?:pay|remit|transfer)") + r".{0,80}as follows *:"

_acts = lambda lang: (7, ACTION[lang])
FRAMES: list[Harvest] = [
    *_both("h4", "obligations", OBLIGATIONS, lambda lang: (_acts(lang), (6, DEADLINE[lang]), _prior("obligations"))),
    *_both("h5", "conditions", CONDITIONS, lambda lang: ((7, _CORROB), (6, DEADLINE[lang]), _prior("conditions"))),
    *_both("h7", "deadlines", DEADLINES, lambda lang: ((6, "."), _acts(lang), _prior("deadlines")), lambda lang, frame: ((44, (W("promptly"),), (W("after|following|upon|receipt"),)), (50, (W(r"report(?:ing)? (?:completion|satisfaction)"),), ()), *(((44, (".",), (W(r"[0-9]+ (?:mois|jours?|semaines?|ans?|heures?)"),)),) if lang == "fr" and "closing" in frame else ()))),
    *_both("h8", "decision_points", CONSENT, lambda lang: (_acts(lang),), lambda lang, frame: ((44, (_MAY,), (ACTION[lang],)),)),
    *[Harvest("h9", lang, "documents", "deliverable_document", 58, W(p), (_DOC_NAME,), (_SCHEDULE,), (_acts(lang), _prior("documents"))) for lang, p in (("en", _DOC_EN), ("fr", _DOC_FR))],
    *[Harvest("h9", lang, "documents", "scheduled_document", 66, W(p), (_SCHEDULE,), (), (_acts(lang), _prior("documents"))) for lang, p in (("en", _DOC_EN), ("fr", _DOC_FR))],
    *[Harvest("h10", lang, "transfers", "payment_flow", 66, PAYMENT[lang], (MONEY[lang],), (_LEAD_IN,), ((6, "."), (6, DEADLINE[lang]), _prior("transfers")), ((50, (_CONTINGENT,), ()),)) for lang in ("en", "fr")],
    Harvest("h10", "en", "claim_classes", "waterfall_sequence", 58, W(r"first|second|then|thereafter|pro rata|pari passu|true-up|setoff|deduct|net of"), ("heading:" + PRIORS["transfers"],), (PAYMENT["en"],)),
    *[Harvest("h11", lang, "conditions", "default_remedy", 58, _REMEDY[lang], signals=((7, W(r"obligation|representation|warranty|covenant|remedy|terminate|cure|résilier|remédier")),)) for lang in ("en", "fr")],
    *[Harvest("h12", lang, "communications", "notice_communication", 62, _NOTICE[lang], signals=(_prior("communications"), (4, _SENDER), (5, _RECIPIENT), (4, _METHOD)), caps=((44, (".",), (_SENDER, _RECIPIENT, _METHOD)),)) for lang in ("en", "fr")],
    *[Harvest("h13", lang, "relationships", "control_authority", 58, _AUTHORITY[lang], signals=(_prior("relationships"), (7, W(r"ownership|voting|affiliate|governance|authority|approval")))) for lang in ("en", "fr")],
    *[Harvest("h6", lang, "controls", "evidence_control", 56, _CONTROL[lang][0], signals=(_prior("controls"), _acts(lang))) for lang in ("en", "fr")],
    Harvest("h6", "en", "controls", "privacy_control", 65, _SECURITY, (), (_CONTROL["en"][0], _DATAFLOW, "heading:" + _SECURITY_HEADING), (_acts("en"),)),
    Harvest("h6", "en", "controls", "privacy_control_under_heading", 68, _SECURITY, ("heading:" + _SECURITY_HEADING,), (_CONTROL["en"][0], _DATAFLOW), ((5, "."), _acts("en"))),
    *[Harvest("h15", lang, "events", frame, base, W(d), needs, never, (), caps) for lang, d in (("en", _D), ("fr", _DF)) for frame, base, needs, never, caps in (("dated_occurrence", 66, (_OCCURRED[lang],), (), ((44, (_HYPOTHETICAL,), ()),)), ("dated_event", 42, (), (_OCCURRED[lang],), ()))],
    Harvest("h18", "en", "concepts", "representation_warranty", 65, _REP),
    Harvest("h18", "fr", "concepts", "representation_warranty", 65, W(r"déclare(?:nt)? et garanti(?:t|ssent)|déclare(?:nt)?|atteste(?:nt)?|véridiques? et exactes?|à tous (?:les )?égards importants|à la connaissance de|sauf divulgation|énoncée?s? à l'annexe")),
]
# Wording around names.
_INTRO = W(r"by and among|by and between|entered into|agreement is (?:entered|made)|is made (?:as of|this)|this \p{L}+ (?:agreement|contract|deed|indenture)")
_DATA_WORDS = W(r"personal information|personal data|payment data|processor|service provider|data processing|privacy")
NAMES: list[Named] = [
    Named("h1", "en", "parties", "defined_party_alias", 88, _NAME + r"(?:, an? [^()]{2,80})? ?\((?:the )?[\"“][A-Za-z][A-Za-z ]{1,40}[\"”]\)"),
    Named("h1", "fr", "parties", "defined_party_alias", 88, _NAME + r",? \(?ci-après (?:désignée? )?(?:la |le |les |l')?« ?[^»]{1,40}»"),
    Named("h1", "en", "parties", "agreement_intro_party", 68, _NAME, (_INTRO,), "party"),
    Named("h1", "en", "parties", "signature_block", 62, r"(?:By|Name|Title): ?([^;]{1,80})", (), "signatory"),
    Named("h2", "en", "parties", "privacy_operator", 80, r"(?:Policy|Notice) describes how " + _NAME, (), "operator"),
    Named("h2", "en", "parties", "privacy_operator", 80, r"\*\*Organi[sz]ation\*\* ?[:-] ?" + _NAME, (), "operator"),
    Named("h2", "en", "parties", "service_provider_item", 78, r"^(?:[-*] )?\*\*" + _NAME + r"\*\* ?:", (W(r"data|personal information|privacy|process(?:ing)?|pci|compliance|payment|access|cloud|infrastructure|support|analytics|ticketing"),), "service provider"),
    Named("h2", "en", "parties", "service_provider_inline", 72, r"(?:transfers? (?:personal information|data) to |integration with |processor, )" + _NAME, (_DATA_WORDS,), "service provider"),
    Named("h2", "en", "parties", "service_provider_listed", 70, _NAME, (W(r"(?:transfer|disclose|share)s? (?:personal information|personal data)"),), "service provider"),
    Named("h13", "en", "ownership_links", "ownership", 78, r"([A-Z][A-Za-z .&]+?) (?:owns?|holds?|beneficially owns|is the record owner of) (?:[0-9]+(?:\.[0-9]+)?%? ?)(?:of )?(?:the )?(?:shares of )?[A-Z]"),
    Named("h13", "fr", "ownership_links", "ownership", 78, r"([A-ZÀ-Þ][\p{L} .&]+?) (?:détient|possède) [0-9]+(?:[.,][0-9]+)? ?% (?:de la |de |du |des |d')?[A-ZÀ-Þ]"),
    Named("h14", "en", "entities", "ownership_participant", 72, _NAME + r" (?:owns?|holds?|beneficially owns)(?: |$)"),
    Named("h14", "en", "entities", "held_by", 70, r"held by " + _NAME), Named("h14", "fr", "entities", "held_by", 70, r"détenue?s? par " + _NAME),
    Named("h14", "en", "entities", "entity_list_item", 72, r"^(?:[-*] )?\*\*" + _NAME + r"\*\* ?:", ("heading:" + W(r"entit(?:y|ies)|structure|corporate group|subsidiaries|membership|parties? to"),)),
    Named("h14", "en", "entities", "acquisition_target", 72, r"shares? of " + _NAME), Named("h14", "fr", "entities", "acquisition_target", 72, r"actions (?:émises et en circulation de|de|visées de) " + _NAME),
]

# Sentences that hold the cases of the frames: language, headings above, text.
CASES: list[tuple[str, str, str]] = [
    ("en", "Covenants", "The Buyer shall not assign this agreement without consent."), ("en", "Covenants", "The Seller shall use commercially reasonable efforts to obtain approvals."), ("en", "Closing", "The Company shall cause its affiliates to deliver the records within 10 business days after Closing."), ("en", "General", "The Borrower must maintain insurance, including without limitation fire cover."),
    ("en", "Conditions", "Closing is subject to the satisfaction of each condition precedent."), ("en", "Conditions", "If the permit lapses, the licence ends."), ("en", "Misc", "Nothing herein shall limit liability other than as stated."), ("en", "Misc", "The grant is contingent upon funding."), ("en", "Timeline", "The report is due no later than January 5, 2026."), ("en", "Timeline", "Reply promptly."), ("en", "Timeline", "The Contractor shall report completion within 5 days after the works."), ("en", "Timeline", "Deliver the keys prior to Closing."),
    ("en", "Timeline", "Records are kept after the Closing Date."), ("en", "Notices", "Either side may leave upon 30 days written notice."), ("en", "Cure", "A breach must be remedied within the cure period."), ("en", "Consent", "The Lender hereby consents to the sale."), ("en", "Consent", "Approval shall not be unreasonably withheld."), ("en", "Consent", "The Owner may object."), ("en", "Consent", "The Agent acts in its sole discretion and may waive any default."),
    ("en", "Deliveries", "The Seller shall deliver an officer's certificate."), ("en", "Deliveries", "The items set forth on Schedule 4 are true and correct."), ("en", "Payment", "The Buyer shall pay $5,000.00 to the Seller within 10 days."), ("en", "Payment", "The Buyer shall pay the purchase price as follows:"), ("en", "Payment", "In the event of a breach the Seller shall pay a fee."), ("en", "Waterfall", "First the senior class, then the others pro rata."), ("en", "Notices", "The Tenant shall notify the Landlord by certified mail."), ("en", "Notices", "Notice is deemed given."), ("en", "Authority", "The Manager has authority to pledge shares with board approval."),
    ("en", "Controls", "Access is verified by the auditor."), ("en", "Security", "Data is protected by encryption."), ("en", "Misc", "We use AES-256 at rest."), ("en", "Misc", "Data is transferred via encryption."), ("en", "History", "The motion was heard on March 3, 2020."), ("en", "History", "A hearing will be convened on March 3, 2030."), ("en", "History", "March 4, 2020 was a Tuesday."), ("en", "Reps", "The Seller represents and warrants title."),
    ("en", "Parties", 'Northgate Acquisitions Corp. (the "Buyer") and Alder Mills Ltd. ("Seller") agree.'), ("en", "Parties", "This Share Agreement is entered into by and among Northgate Acquisitions Corp. and Alder Mills Ltd."), ("en", "Signatures", "By: Jane Doe"), ("en", "Privacy", "This Privacy Policy describes how Cedar Health Inc. collects data."), ("en", "Privacy", "**Organization:** Cedar Health Inc."), ("en", "Privacy", "**Organization**: Cedar Health Inc."), ("en", "Third parties", "**Stonepay Corp.**: receives payment data for billing."), ("en", "Third parties", "Through our integration with Stonepay Corp. personal information moves."), ("en", "Third parties", "We share personal data with Vaultline LLC and Stonepay Corp. only."),
    ("en", "Structure", "Alpha Holdings Inc. owns 60% of Beta Mills Ltd."), ("en", "Structure", "The rest is held by Gamma Partners LP."), ("en", "Entities", "**Delta Works GmbH**: the operating company."), ("en", "Recitals", "The Buyer acquires all shares of Epsilon Foods Company."),
    ("fr", "Obligations", "Le Preneur ne doit pas céder le bail."), ("fr", "Obligations", "Le Vendeur s’engage à fournir les livres et registres dans les 10 jours suivant la demande."), ("fr", "Clôture", "Le Vendeur remet les clés avant la clôture."), ("fr", "Conditions", "À condition que le permis soit délivré, la vente est subordonnée à l'accord."), ("fr", "Conditions", "Sauf disposition contraire, en cas de défaut le bail prend fin."), ("fr", "Délais", "Le rapport est remis au plus tard le 5 janvier 2026."), ("fr", "Délais", "Le bail prend fin moyennant un préavis de 30 jours."), ("fr", "Accord", "L'approbation ne peut être refusée."), ("fr", "Accord", "La banque peut s'opposer et le bailleur agit à sa seule discrétion."),
    ("fr", "Prix", "L'acheteur verse 5 000 $ au vendeur avant la clôture."), ("fr", "Avis", "Le locataire avise le bailleur par courrier recommandé."), ("fr", "Contrôle", "Les accès sont vérifiés par l'auditeur."), ("fr", "Pouvoirs", "Le gérant est dûment autorisé à nantir les actions."), ("fr", "Histoire", "Le jugement a été rendu le 1er mars 2020."), ("fr", "Garanties", "Le vendeur déclare et garantit le titre."), ("fr", "Parties", "Gestion Alder Inc., ci-après désignée « Vendeur », comparaît."), ("fr", "Structure", "Gestion Alder détient 60 % de Moulins Beta."), ("fr", "Structure", "Le solde est détenu par Boréal Ltée et les actions de Forge Delta Inc. sont libres."),
    ("fr", "Obligations", "Le Preneur continue de chauffer les lieux."), ("fr", "Obligations", "Chacun fait de meilleurs efforts."), ("fr", "Obligations", "La Société veille à ce que ses filiales agissent."), ("fr", "Clôture", "Les archives sont gardées après la clôture."), ("fr", "Délais", "Le défaut est corrigé dans un délai de dix jours, soit le délai de remédiation."),
    ("fr", "Accord", "La banque consent à la vente."), ("fr", "Accord", "La cession est nulle sans le consentement du bailleur."), ("fr", "Accord", "Toute renonciation à un droit est écrite."), ("fr", "Documents", "Le Vendeur remet l'annexe 2 à l'acheteur."),
]
_FIX = [(-(k + 1), 0, lang, head, text) for k, (lang, head, text) in enumerate(CASES)]


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, idx, pos, sent, low, heading, lang`` of all paragraphs and list items, and of the cases."""
    b = table(spark, d, "blocks").where("block_type IN ('paragraph', 'list_item') AND text IS NOT NULL")
    b = b.select("doc_id", "idx", F.when(F.lower("lang").startswith("fr"), "fr").otherwise("en").alias("lang"), F.coalesce(F.array_join("heading_path", " > "), F.lit("")).alias("heading"), "text").distinct()
    b = b.unionByName(fixture(spark, _FIX, "doc_id long, idx int, lang string, heading string, text string"))
    s = b.select("doc_id", "idx", "lang", F.lower("heading").alias("heading"), F.posexplode(_split(F.col("text"))).alias("pos", "sent")).withColumn("pos", F.col("pos") + 1)
    return s.withColumn("low", F.lower(F.replace("sent", F.lit("’"), F.lit("'"))))


_SENTENCES_SQL = f"""b AS (SELECT DISTINCT doc_id, idx, CASE WHEN starts_with(lower(lang), 'fr') THEN 'fr' ELSE 'en' END AS lang, lower(coalesce(array_to_string(heading_path, ' > '), '')) AS heading, text FROM blocks WHERE block_type IN ('paragraph', 'list_item') AND text IS NOT NULL
 UNION ALL SELECT doc_id, idx, lang, lower(heading), text FROM {values(_FIX, 'doc_id, idx, lang, heading, text')}),
s AS MATERIALIZED (SELECT *, lower(replace(sent, '’', '''')) AS low FROM (SELECT doc_id, idx, lang, heading, generate_subscripts(p, 1) AS pos, replace(unnest(p), chr(1), '.') AS sent FROM (SELECT *, {_SPLIT_SQL} AS p FROM b)))"""


def _fits(p: str) -> Column:
    return F.col("heading").rlike(p.removeprefix("heading:")) if p.startswith("heading:") else F.col("low").rlike(p)


def _all(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def _scored(f: Harvest, anti: Column) -> Column:
    score = F.lit(f.base)
    for w, p in f.signals:
        score = score + (F.lit(w) if p == "." else w * _fits(p).cast("int"))
    score = score - anti
    for cap, when, unless in f.caps:
        held = _all([_fits(p) for p in when if p != "."] + [~_fits(p) for p in unless])
        score = F.when(held, F.least(score, F.lit(cap))).otherwise(score)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def candidates(sents: DataFrame, frames: list[Harvest], keep: tuple[str, ...] = ()) -> DataFrame:
    """``frame, field, score`` of each sentence and frame that fits it, with the columns to keep."""
    anti = F.least(F.lit(28), 7 * sum((F.col("low").rlike(p).cast("int") for p in ANTI.values()), F.lit(0)))
    hits = [F.when(_all([F.col("lang") == f.lang, F.col("low").rlike(f.pattern), *[_fits(p) for p in f.needs], *[~_fits(p) for p in f.never]]), F.struct(F.lit(f.frame).alias("frame"), F.lit(f.field).alias("field"), _scored(f, anti).alias("score"))) for f in frames]
    return sents.select("doc_id", "idx", "pos", *keep, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).select("doc_id", "idx", "pos", *keep, "x.*")


def clean_party(c: Column) -> Column:
    """Single spaces, no article before, no verb after, no stray punctuation."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\n\r]+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    c = F.regexp_replace(c, r"^[Tt]he +", "")
    return F.regexp_replace(F.regexp_replace(c, r" +(?:shall|must|will|may|agrees?|undertakes|covenants)$", ""), r"^[()\[\]{}\"']+|[()\[\]{}\"']+$", "")


def named(sents: DataFrame, frames: list[Named]) -> DataFrame:
    """``frame, field, score, name`` of every name that a frame finds."""
    found = lambda f: F.when(_all([F.col("lang") == f.lang, *[_fits(p) for p in f.needs]]), F.transform(F.regexp_extract_all("sent", F.lit(f.name), 1), lambda n: F.struct(F.lit(f.frame).alias("frame"), F.lit(f.field).alias("field"), F.lit(f.base).alias("score"), F.lit(f.role).alias("role"), clean_party(n).alias("name"))))
    every = F.flatten(F.filter(F.array(*[found(f) for f in frames]), lambda x: x.isNotNull()))
    return sents.select("doc_id", "idx", "pos", F.explode(every).alias("x")).select("doc_id", "idx", "pos", "x.*").where("name <> ''").distinct()


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _fits_sql(p: str) -> str:
    return f"regexp_matches(heading, {_q(p.removeprefix('heading:'))})" if p.startswith("heading:") else f"regexp_matches(low, {_q(p)})"


_ANTI_SQL = "least(28, 7 * (" + " + ".join(f"CAST({_fits_sql(p)} AS INTEGER)" for p in ANTI.values()) + "))"


def _score_sql(f: Harvest) -> str:
    score = " + ".join([str(f.base), *[str(w) if p == "." else f"{w} * CAST({_fits_sql(p)} AS INTEGER)" for w, p in f.signals]]) + f" - {_ANTI_SQL}"
    for cap, when, unless in f.caps:
        held = " AND ".join(["true", *[_fits_sql(p) for p in when if p != "."], *[f"NOT {_fits_sql(p)}" for p in unless]])
        score = f"CASE WHEN {held} THEN least({score}, {cap}) ELSE {score} END"
    return f"CAST(least(greatest({score}, 0), 100) AS INTEGER)"


def _frames_sql(frames: list[Harvest], keep: str = "") -> str:
    return f"WITH {_SENTENCES_SQL} " + " UNION ALL ".join(
        f"SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos{keep}, '{f.frame}' AS frame, '{f.field}' AS field, {_score_sql(f)} AS score FROM s WHERE lang = '{f.lang}' AND {' AND '.join([f'regexp_matches(low, {_q(f.pattern)})', *map(_fits_sql, f.needs), *[f'NOT {_fits_sql(p)}' for p in f.never]])}" for f in frames
    )


def _clean_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '[ \t\n\r]+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g')"
    return rf"""regexp_replace(regexp_replace(regexp_replace({x}, '^[Tt]he +', ''), ' +(?:shall|must|will|may|agrees?|undertakes|covenants)$', ''), '^[()\[\]{{}}"'']+|[()\[\]{{}}"'']+$', '', 'g')"""


def _names_sql(frames: list[Named]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, '{f.frame}' AS frame, '{f.field}' AS field, {f.base} AS score, '{f.role}' AS role, unnest(regexp_extract_all(sent, {_q(f.name)}, 1)) AS raw FROM s WHERE {' AND '.join([f'lang = {_q(f.lang)}', *map(_fits_sql, f.needs)])}" for f in frames
    )
    return f"WITH {_SENTENCES_SQL} SELECT DISTINCT doc_id, idx, pos, frame, field, score, role, {_clean_sql('raw')} AS name FROM ({rows}) WHERE {_clean_sql('raw')} <> ''"


def _register_frames(name: str, op: str) -> None:
    frames = [f for f in FRAMES if f.op == op]
    query(_frames_sql(frames), name)(lambda spark, d: candidates(sentences(spark, d), frames))


def _register_names(name: str, op: str) -> None:
    frames = [f for f in NAMES if f.op == op]
    query(_names_sql(frames), name)(lambda spark, d: named(sentences(spark, d), frames))


for _name, _op in (("h4_obligations", "h4"), ("h5_conditions", "h5"), ("h6_controls", "h6"), ("h7_deadlines", "h7"), ("h8_consent", "h8"), ("h9_documents", "h9"), ("h10_payments", "h10"), ("h11_remedies", "h11"), ("h12_notices", "h12"), ("h13_authority", "h13"), ("h15_dated_events", "h15"), ("h18_warranties", "h18")):
    _register_frames(_name, _op)
for _name, _op in (("h1_party_aliases", "h1"), ("h2_privacy_parties", "h2"), ("h13_owners", "h13"), ("h14_entities", "h14")):
    _register_names(_name, _op)


@query(f"SELECT DISTINCT party_id, {_clean_sql('name')} AS clean FROM parties WHERE name IS NOT NULL")
def t9_clean_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parties").where("name IS NOT NULL").select("party_id", clean_party(F.col("name")).alias("clean")).distinct()


_PAYER = r"([A-Z][A-Za-z .&']+?) (?:shall |must |will |agrees? to )?(?:pay|reimburse|fund|deposit|remit|wire|transfer) .+? to (?:the )?([A-Z][A-Za-z .&']+?)(?: (?:on|within|at|by|upon|following|after) |[.;,]|$)"


@query(rf"WITH {_SENTENCES_SQL} SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, {_clean_sql(f'regexp_extract(sent, {_q(_PAYER)}, 1)')} AS payer, {_clean_sql(f'regexp_extract(sent, {_q(_PAYER)}, 2)')} AS payee FROM s WHERE regexp_matches(sent, {_q(_PAYER)})")
def t13_payer_payee(spark: SparkSession, d: str) -> DataFrame:
    s = sentences(spark, d).where(F.col("sent").rlike(_PAYER))
    part = lambda k: clean_party(F.regexp_extract("sent", _PAYER, k))
    return s.select("doc_id", "idx", "pos", part(1).alias("payer"), part(2).alias("payee"))


# Names of documents by precedence.
_TITLES = (
    r"((?:Schedule|Exhibit|Annexe?)(?: No\.?)? [0-9A-Z][0-9A-Za-z.]*)", r"((?:officer's|secretary's|bring-down|compliance) certificate|executed counterpart|books and records)",
    r"((?:[A-Z][A-Za-z]+ ){1,6}(?:Agreement|Contract|Deed|Instrument|Certificate|Notice|Licence|License|Policy|Plan|Report|Statement|Order|Approval|Consent|Letter|Opinion|Release|Amendment|Waiver))",
)


@query(f"WITH {_SENTENCES_SQL} SELECT * FROM (SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, coalesce({', '.join(f'nullif(regexp_extract(sent, {_q(p)}, 1), {chr(39) * 2})' for p in _TITLES)}) AS document FROM s) WHERE document IS NOT NULL")
def t15_document_names(spark: SparkSession, d: str) -> DataFrame:
    """The most specific name of a document in a sentence: a numbered annex, a known certificate, a capitalised title."""
    pick = F.coalesce(*[F.nullif(F.regexp_extract("sent", p, 1), F.lit("")) for p in _TITLES])
    return sentences(spark, d).select("doc_id", "idx", "pos", pick.alias("document")).where("document IS NOT NULL")


_WHEN = (_D, r"within [0-9]+ (?:business )?days? (?:after|of)", r"prior to closing", r"following closing", r"promptly after[^.;,]{0,60}", r"as soon as practicable after[^.;,]{0,60}", r"[0-9]+ (?:business )?days?'? (?:prior )?written notice")


@query(f"WITH {_SENTENCES_SQL} SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, coalesce({', '.join(f'nullif(regexp_extract(low, {_q(p)}, 0), {chr(39) * 2})' for p in _WHEN)}) AS timing FROM s WHERE regexp_matches(low, {_q(DEADLINE['en'])})")
def d24_deadline_text(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a sign of a deadline: the date, else the relative phrase, else null."""
    pick = F.coalesce(*[F.nullif(F.regexp_extract("low", p, 0), F.lit("")) for p in _WHEN])
    return sentences(spark, d).where(F.col("low").rlike(DEADLINE["en"])).select("doc_id", "idx", "pos", pick.alias("timing"))


# ---- over whole blocks, and over documents

# Captions of cases in both languages, and words before a name that are none of it.
_CAPTION = {"en": r"([A-Z][A-Za-z0-9.&' ]*?) +(?:vs?\.?) +([A-Z][A-Za-z0-9.&' ]*?[A-Za-z0-9]\.?)(?: +[a-z]| *,| *et al| *$)", "fr": r"([A-ZÀ-Þ][\p{L}\p{N}'.& -]*?) +c\. +([A-ZÀ-Þ][\p{L}\p{N}'.& -]*?[\p{L}\p{N}]\.?)(?: +[a-zà-ÿ]| *,| *et al| *$)"}
_LEADING = r"^(?:(?:[Ii]n|[Tt]he|[Oo]n|[Aa]t|[Ff]or|[Ss]ee|[Pp]er|[Uu]nder|[Rr]e|[Bb]etween|[Cc]f|[Cc]ompare) +)+"
_CAP_FIX = [(-1, 0, "en", "In re The Smith Estate v. Jones Ltd, heard below"), (-2, 0, "fr", "Tremblay c. Daigle, en appel"), (-3, 0, "en", "no caption here")]
_SIDES_SQL = lambda k: " UNION ALL ".join(f"SELECT doc_id, idx, unnest(regexp_extract_all(text, {_q(p)}, {k})) AS raw, {k} AS side FROM bb WHERE lang = '{lang}'" for lang, p in _CAPTION.items())


def _side_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({x}), '[.,;: ]+$', ''), '{_LEADING}', '')"


@query(f"""WITH bb AS (SELECT DISTINCT doc_id, idx, CASE WHEN starts_with(lower(lang), 'fr') THEN 'fr' ELSE 'en' END AS lang, replace(text, chr(10), ' ') AS text FROM blocks WHERE text IS NOT NULL AND block_type <> 'heading' UNION ALL SELECT * FROM {values(_CAP_FIX, 'doc_id, idx, lang, text')})
 SELECT DISTINCT doc_id, idx, side, {_side_sql('raw')} AS party, 60 AS score FROM ({_SIDES_SQL(1)} UNION ALL {_SIDES_SQL(2)}) WHERE regexp_matches({_side_sql('raw')}, '^\\p{{Lu}}.')""")
def h3_captions(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of each caption of a block, looked for before it is split into sentences."""
    b = table(spark, d, "blocks").where("text IS NOT NULL AND block_type <> 'heading'").select("doc_id", "idx", F.when(F.lower("lang").startswith("fr"), "fr").otherwise("en").alias("lang"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).distinct()
    b = b.unionByName(fixture(spark, _CAP_FIX, "doc_id long, idx int, lang string, text string"))
    side = lambda k: F.transform(F.coalesce(*[F.when(F.col("lang") == lang, F.regexp_extract_all("text", F.lit(p), k)) for lang, p in _CAPTION.items()]), lambda x: F.struct(F.lit(k).alias("side"), F.regexp_replace(F.regexp_replace(F.trim(x), "[.,;: ]+$", ""), _LEADING, "").alias("party")))
    rows = b.select("doc_id", "idx", F.explode(F.concat(side(1), side(2))).alias("x")).select("doc_id", "idx", "x.*")
    return rows.where(F.col("party").rlike(r"^\p{Lu}.")).distinct().withColumn("score", F.lit(60))


_ROLES = {"en": "plaintiff|defendant|vendor|purchaser|employee|buyer|seller", "fr": "demandeur|demanderesse|défendeur|défenderesse|vendeur|venderesse|acheteur|acheteuse|employé"}
_RUN = r"[A-ZÀ-ÖØ-Þ][\p{L}\p{N}&'-]*(?: [A-ZÀ-ÖØ-Þ][\p{L}\p{N}&'-]*)+"
_MONTH = W("january|february|march|april|may|june|july|august|september|october|november|december|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre")


@query(f"""WITH {_SENTENCES_SQL}, m AS (SELECT doc_id, idx, lower(run) AS key, run, regexp_matches(low, CASE WHEN lang = 'fr' THEN '{_ROLES["fr"]}' ELSE '{_ROLES["en"]}' END) AS role FROM (SELECT doc_id, idx, lang, low, sent, unnest(regexp_extract_all(sent, {_q(_RUN)})) AS run FROM s) WHERE NOT starts_with(sent, run) AND NOT regexp_matches(lower(run), {_q(_MONTH)}))
 SELECT doc_id, min(run) AS mention, count(DISTINCT idx) AS blocks, 50 AS score FROM m GROUP BY doc_id, key HAVING count(DISTINCT idx) >= 2 AND bool_or(role)""")
def h20_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of capitalised words in two blocks or more of a document, once at least beside the word of a role."""
    s = sentences(spark, d)
    role = F.when(F.col("lang") == "fr", F.col("low").rlike(_ROLES["fr"])).otherwise(F.col("low").rlike(_ROLES["en"]))
    m = s.select("doc_id", "idx", "sent", role.alias("role"), F.explode(F.regexp_extract_all("sent", F.lit(_RUN), 0)).alias("run")).where("NOT startswith(sent, run)").where(~F.lower("run").rlike(_MONTH))
    g = m.groupBy("doc_id", F.lower("run").alias("key")).agg(F.min("run").alias("mention"), F.count_distinct("idx").alias("blocks"), F.bool_or("role").alias("role"))
    return g.where("blocks >= 2 AND role").select("doc_id", "mention", "blocks", F.lit(50).alias("score"))


_HEADS = {"condition_section": (52, r"conditions? precedent|closing conditions?"), "document_section": (48, r"closing deliver(?:y|ies)|documents?|certificates?")}
_HEAD_FIX = [(-1, 0, "Conditions Precedent"), (-2, 0, "Closing deliveries and certificates"), (-3, 0, "Notices")]


@query("WITH hh AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL UNION ALL SELECT * FROM " + values(_HEAD_FIX, "doc_id, idx, text") + ") " + " UNION ALL ".join(f"SELECT doc_id, idx, '{f}' AS frame, {n} AS score FROM hh WHERE regexp_matches(lower(text), {_q(p)})" for f, (n, p) in _HEADS.items()))
def h21_section_headings(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "blocks").where("block_type = 'heading' AND text IS NOT NULL").select("doc_id", "idx", "text").distinct().unionByName(fixture(spark, _HEAD_FIX, "doc_id long, idx int, text string"))
    hits = F.array(*[F.when(F.lower("text").rlike(p), F.struct(F.lit(f).alias("frame"), F.lit(n).alias("score"))) for f, (n, p) in _HEADS.items()])
    return h.select("doc_id", "idx", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select("doc_id", "idx", "x.*")


_LIST_SQL = lambda table_, col: "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({col}, {_q(p)}) THEN '{k}' END" for k, p in table_.items()) + "], lambda x: x IS NOT NULL))"


@query(f"WITH {_SENTENCES_SQL} SELECT * FROM (SELECT doc_id, idx, CAST(pos AS INTEGER) AS pos, array_to_string({_LIST_SQL(ANTI, 'low')}, ',') AS weakens, array_to_string({_LIST_SQL(PRIORS, 'heading')}, ',') AS priors FROM s) WHERE weakens <> '' OR priors <> ''")
def h22_signals(spark: SparkSession, d: str) -> DataFrame:
    """Wording that weakens a candidate, and the fields that the headings above speak for."""
    of = lambda t, c: F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(c).rlike(p), F.lit(k)) for k, p in t.items()]), lambda x: x.isNotNull())), ",")
    return sentences(spark, d).select("doc_id", "idx", "pos", of(ANTI, "low").alias("weakens"), of(PRIORS, "heading").alias("priors")).where("weakens <> '' OR priors <> ''")


_CANLII = r"((?:[A-Z][\p{L}\p{N}.&'-]* ){1,6}v\.? (?:[A-Z][\p{L}\p{N}.&'-]*,? ){1,6})?((?:19|20)[0-9]{2} CanLII [0-9]+(?: \([A-Z]{2}(?: [A-Z]{2,4})?\))?)"
_CANLII_FIX = [(-1, 0, "As held in Pro Sys Co. v. Delta Inc., 2003 CanLII 55 (ON CA), costs follow."), (-2, 0, "See 1999 CanLII 7 and 2001 CanLII 8."), (-3, 0, "nothing")]


@query(rf"""WITH bb AS (SELECT DISTINCT doc_id, idx, text FROM blocks WHERE contains(text, 'CanLII') UNION ALL SELECT * FROM {values(_CANLII_FIX, 'doc_id, idx, text')}), x AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, {_q(_CANLII)}, 1)) AS name, unnest(regexp_extract_all(text, {_q(_CANLII)}, 2)) AS cite FROM bb)
 SELECT DISTINCT doc_id, idx, CASE WHEN coalesce(name, '') = '' THEN cite ELSE regexp_replace(name, '[,. ]+$', '') || ', ' || cite END AS citation, 84 AS score FROM x""")
def h17_block_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of a reporter with the case name right before them, over unsplit blocks."""
    b = table(spark, d, "blocks").where(F.col("text").contains("CanLII")).select("doc_id", "idx", "text").distinct().unionByName(fixture(spark, _CANLII_FIX, "doc_id long, idx int, text string"))
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(_CANLII), 1).alias("name"), F.regexp_extract_all("text", F.lit(_CANLII), 2).alias("cite"))
    rows = b.select("doc_id", "idx", F.explode(pairs).alias("x"))
    named_ = F.concat_ws(", ", F.regexp_replace("x.name", "[,. ]+$", ""), "x.cite")
    return rows.select("doc_id", "idx", F.when(F.coalesce("x.name", F.lit("")) == "", F.col("x.cite")).otherwise(named_).alias("citation"), F.lit(84).alias("score")).distinct()


# Words that alone name a role, not a party.
ROLE_WORDS = "company vendor purchaser seller buyer licensor licensee borrower lender lessor lessee franchisor franchisee employer employee contractor subcontractor customer client supplier agent principal guarantor".split()
_ROLE_FIX = [(-1, 0, 'Northgate Acquisitions Corp. (the "Vendor") agrees.'), (-2, 0, "Nobody is defined.")]
_TABLE_FIX = [(-1, 1, "Vendor | pays | soon | open"), (-1, 2, "Alder Mills Ltd. | pays | soon | open"), (-2, 1, "Vendor | pays | soon | open")]
_DEFINED = r"\((?:the )?[\"“]([A-Za-z][A-Za-z ]{1,40})[\"”]\)"


@query(f"""WITH t AS (SELECT DISTINCT doc_id, idx, trim(string_split(text, ' | ')[1]) AS party FROM blocks WHERE block_type = 'table_row' AND text IS NOT NULL UNION ALL SELECT doc_id, idx, trim(string_split(text, ' | ')[1]) FROM {values(_TABLE_FIX, 'doc_id, idx, text')}),
 p AS (SELECT doc_id, text FROM blocks WHERE text IS NOT NULL UNION ALL SELECT doc_id, text FROM {values(_ROLE_FIX, 'doc_id, idx, text')}), r AS (SELECT DISTINCT doc_id, role FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, {_q(_DEFINED)}, 1))) AS role FROM p) WHERE role IN ({', '.join(map(_q, ROLE_WORDS))}))
 SELECT t.doc_id, t.idx, party, r.role IS NOT NULL AS suppressed FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND lower(t.party) = r.role WHERE party <> ''""")
def j7_role_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Table parties that are one word which the same document defines as the role of a named party."""
    blocks = table(spark, d, "blocks").where("text IS NOT NULL")
    cell = F.trim(F.split("text", r" \| ").getItem(0))
    t = blocks.where("block_type = 'table_row'").select("doc_id", "idx", cell.alias("party")).distinct().unionByName(fixture(spark, _TABLE_FIX, "doc_id long, idx int, text string").select("doc_id", "idx", cell.alias("party")))
    texts = blocks.select("doc_id", "text").unionByName(fixture(spark, _ROLE_FIX, "doc_id long, idx int, text string").select("doc_id", "text"))
    r = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_DEFINED), 1)).alias("role")).select("doc_id", F.lower("role").alias("role")).where(F.col("role").isin(*ROLE_WORDS)).distinct()
    joined = t.where("party <> ''").join(r.withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & (F.lower("party") == F.col("role")), "left")
    return joined.select("doc_id", "idx", "party", F.col("role").isNotNull().alias("suppressed"))
