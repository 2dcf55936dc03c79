"""What the detectors look for, in Java's dialect.

`value` patterns have two groups, what stands before the value and the value; a match in which the
second is empty counts as a whole. `whole` patterns have no group that matters.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Pattern(NamedTuple):
    name: str
    category: str
    confidence: float
    kind: str
    regex: str
    ignore_case: bool = True
    source: str = "regex"
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """Unicode classes and case folding, and only \\n as a line's end, as in Python."""
        first = FIRST.get(self.name) if self.source != "baseline" else None
        return ("(?diuU)" if self.ignore_case else "(?dU)") + (f"(?=[{first}])(?:{self.regex})" if first else self.regex)

    @property
    def re2(self) -> str:
        """For DuckDB; patterns that look ahead have no such form."""
        return ("(?i)" if self.ignore_case else "") + self.regex.replace(r"À-ɏ", r"\x{00C0}-\x{024F}")


_NUMBER = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}(?:\s*(?:ext|x|ext\.)\s*\d{1,5})?"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_WORD = r"[A-ZÀ-ɏ][a-zA-Z0-9_À-ɏ\.'-]+"
_NAME = rf"{_WORD}(?:\s+{_WORD}){{0,2}}(?:-{_WORD})?"
_CREDENTIAL = r"MD|M\.D\.|DO|D\.O\.|MBBS|PhD|PsyD|FACS|FACP|RN|NP|PA|CCP|RDCS|CEP|MS,\s*CEP|PA-C|CRNA|DPT|OTR/L|MSW|LCSW|CGC|MS,\s*CGC|MPH"

SSN = Pattern("ssn", "SSN", 0.99, "whole", r"\b\d{3}-\d{2}-\d{4}\b|\b\*{3}-\*{2}-\d{4}\b|\bSSN[:\s#]*([0-9]{9})\b")
MRN = Pattern("mrn", "MRN", 0.98, "value", r"\b((?:MRN|MR#|Medical\s+Record\s+(?:#|Number|No\.)|Chart\s+(?:#|Number|No\.)|Patient\s+ID|Account\s+ID)[:\s#]*)([A-Z0-9-]{4,18})\b")
PHONE = Pattern("phone", "PHONE", 0.98, "value", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?:\s*(?:ext|x|ext\.)\s*\d{1,5})?\b|\b(?:\+?1[-.\s]?)?\(\d{3}\)\s*\d{3}[-.\s]?\d{4}\b|" + rf"\b((?:Phone|Tel|Telephone|Cell|Mobile|Callback)[:\s#]*)({_NUMBER})\b")
FAX = Pattern("fax", "FAX", 0.99, "value", rf"\b((?:Fax|Facsimile|Fx)[:\s#]*)({_NUMBER})\b")
EMAIL = Pattern("email", "EMAIL", 0.99, "whole", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
IPV4 = Pattern("ipv4", "IP", 0.99, "whole", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False)
IPV6 = Pattern("ipv6", "IP", 0.99, "whole", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", False)
URL = Pattern("url", "URL", 0.99, "whole", r"\bhttps?://[^\s/$.?#].[^\s]*\b")
MBI = Pattern("mbi", "HEALTHPLAN", 0.98, "whole", r"\b[1-9][AC-HJ-NP-RT-Y][AC-HJ-NP-RT-Y0-9][0-9][- ]?[AC-HJ-NP-RT-Y][AC-HJ-NP-RT-Y0-9][0-9][- ]?[AC-HJ-NP-RT-Y]{2}[0-9]{2}\b", False)
HEALTHPLAN = Pattern("healthplan", "HEALTHPLAN", 0.98, "value", r"\b(?:BCBS-[A-Z0-9-]{4,16}|GRP-[A-Z0-9-]{4,16}|((?:Insur[a-z]*|Policy|Group|Member|Medicaid|MBI)[\s#:]*(?:ID|#|Policy|No\.?)?[:\s#]*)([A-Z0-9-]{4,20}))\b")
ACCOUNT = Pattern("account", "ACCOUNT", 0.98, "value", r"\b((?:HAR|Billing\s+Acct(?:\s+#)?|Billing\s+Account|Guarantor\s+Account|Account\s+#|Acct\s+#)[:\s#]*)([A-Z0-9-]{4,24})\b")
NPI = Pattern("npi", "NPI", 0.99, "value", r"\b((?:NPI|National\s+Provider\s+Identifier)[:\s#]*)([1-9]\d{9})\b")
DEA = Pattern("dea", "LICENSE", 0.99, "value", r"\b((?:DEA|DEA\s+#)[:\s#]*)([A-Z]{2}\d{7})\b")
LICENSE = Pattern("license", "LICENSE", 0.98, "value", r"\b((?:Medical\s+License|State\s+License|License\s+(?:#|Number)|DL|Driver(?:'?s)?\s+License)[:\s#]*)([A-Z0-9-]{4,18})\b|\b(?:MD|RN|DO|PA|PSY)-[A-Z]{2}-[A-Z0-9]{4,12}\b|\b[A-Z]{2}-(?:MD|DO|RN|PA|PSY)-[A-Z0-9]{4,12}\b|\b[A-Z]{2}-[0-9]{5,10}\b")
VIN = Pattern("vin", "VEHICLE", 0.99, "value", r"\b((?:VIN|Vehicle\s+ID)[:\s#]*)([A-HJ-NPR-Z0-9]{17})\b")
PLATE = Pattern("plate", "VEHICLE", 0.98, "value", r"\b((?:License\s+Plate|Plate\s+#|Tag\s+#|Vehicle\s+Tag|Plate)[:\s#]*)([A-Z0-9\s-]{4,12})\b")
DEVICE = Pattern("device", "DEVICE", 0.98, "value", r"\b((?:SN|S/N|Serial\s+(?:#|Number|No\.)|UDI|Device\s+(?:ID|SN)|Implant\s+(?:Lot|SN|#)|Pacemaker\s+SN|Pacemaker\s+Serial\s+Number\s+SN)[:\s#]*)([A-Z0-9-]{4,28})\b|\(\d{2}\)\d{10,16}(?:\(\d{2}\)[A-Z0-9]+)*|\bLOT-[A-Z0-9-]{4,20}\b|\bSN-[A-Z0-9-]{4,24}\b")
BIOMETRIC = Pattern("biometric", "BIOMETRIC", 0.98, "value", r"\b((?:(?:Retinal\s+Scan|Fingerprint|Voiceprint|DNA\s+Accession|Biometric)(?:\s+Biometric)?(?:\s+ID|\s+Scan|\s+Signature)?|\bBiometric\s+ID)[:\s#]*)([A-Z0-9-]{4,28})\b|\bVOICE-BIO-[A-Z0-9-]{4,20}\b")
PHOTO = Pattern("photo", "PHOTO", 0.98, "value", r"\b((?:(?:Full\s+face\s+photo|Facial\s+photo(?:graph)?(?:\s+reference)?|Pre-op\s+facial\s+photo|Patient\s+portrait|Photo(?:graph)?|Image|Attached|Attachment)[:\s#]*(?:attached[:\s#]*)?)+)([A-Za-z0-9_.-]+\.(?:jpg|jpeg|png|dicom|dcm|tiff|gif))\b|\b(?:[A-Za-z0-9_.-]+(?:face|portrait|patient|setup_photo)[A-Za-z0-9_.-]*\.(?:jpg|jpeg|png|dicom|dcm))\b")
ACCESSION = Pattern("accession", "ACCESSION", 0.98, "value", r"\b((?:Accession\s+(?:#|Number|No\.)|Specimen\s+(?:ID|#|Barcode)|Trial\s+Subject\s+ID|Study\s+Subject\s+ID|Subject\s+ID|Trial\s+ID|TB\s+Case\s+ID|Case\s+ID|Chromosomal\s+Microarray\s+ID|Microarray\s+ID|Protocol\s+ID|Pathology\s+ID|Barcode)[:\s#]*)([A-Z0-9-]{4,28})\b|\b(?:EC|LAB|ACC|SPEC|PATH|RAD|GEN|DNA|CT|ONC|CARD|NEURO|SURG|TX|RX|CMA|TB-CASE|CPD|CHP|PATH-IHC|IHC-BAR|BARCODE-DNA)-[A-Z0-9-]{4,24}\b")
STREET = Pattern("street", "ADDRESS", 0.97, "whole", r"\b\d{1,5}\s+[A-Za-z0-9\.\s\-]+?\s+(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Way|Parkway|Pkwy\.?|Circle|Cir\.?|Terrace|Ter\.?)(?:,?\s+(?:Apt|Suite|Unit|Ste|Building|Bldg|Floor|Fl)\.?\s*[A-Za-z0-9#-]+)?\b")
ZIP = Pattern("zip", "ZIP", 0.95, "whole", r"\b\d{5}(?:-\d{4})?\b", False)
GPS = Pattern("gps", "ADDRESS", 0.99, "whole", r"\b(?:Lat(?:itude)?[:\s]*)?-?\d{1,3}\.\d{3,6}°?\s*(?:N|S)?,?\s*(?:Long(?:itude)?[:\s]*)?-?\d{1,3}\.\d{3,6}°?\s*(?:E|W)?\b")
CITY_STATE_ZIP = Pattern("city_state_zip", "CITY", 0.97, "city", r"\b([A-Z][a-zA-Z\s.-]+?)(,\s+[A-Z]{2}\s+)(\d{5}(?:-\d{4})?)\b", False)
COUNTY = Pattern("county", "COUNTY", 0.97, "whole", r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+County)\b", False, "gazetteer")
DATE = Pattern("date", "DATE", 0.98, "whole", rf"\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}-\d{{1,2}}-\d{{2,4}}|\d{{1,2}}/\d{{4}}|\d{{1,2}}-\d{{4}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\.?\s+\d{{2,4}}|{_MONTH}\.?\s+\d{{4}})\b")
AGE = Pattern("age", "AGE", 0.99, "value", r"\b((?:(?:age|aged)\s*[:\s]+)?)((?:9[0-9]|1[0-2][0-9])\s*(?:-|–|\s)?(?:yo|y/o|y\.o\.|yo/f|yo/m|yr\s+old|yrs\s+old|years?\s+old|-year-old|-yr-old|years?\s+of\s+age)|(?:nonagenarian|centenarian)|(?:9[0-9]|1[0-2][0-9])(?:th|st|nd|rd)\s+birthday|turned\s+(?:9[0-9]|1[0-2][0-9])|(?:age|aged)\s*[:\s]+\s*(?:9[0-9]|1[0-2][0-9])\b)")

PATIENT_HEADER = Pattern("patient_header", "PATIENT", 0.99, "stripped", r"\b((?:P[a-z]{3,6}nt(?:\s+Name)?|PATIENT(?:\s+NAME)?|PT\.?|INFANT|BABY|CHILD|NEONATE|SUBJECT)\s*[:#]\s*(?:Dr\.?\s+)?)([A-Za-z0-9_À-ɏ\.'\s-]+?(?:\s*\([A-Za-z0-9_À-ɏ\.'\s-]+\))?)(?=\s*\||\s*\n|\s*;|\s*,|\s*\[|\s*\((?:DOB|Age|MRN|SSN|ID|Date)|\s*$)", True, "heuristics")
PATIENT_HONORIFIC = Pattern("patient_honorific", "PATIENT", 0.98, "stripped", r"\b((?:Mr\.?|Mrs\.?|Ms\.?|Miss)\s+)([A-ZÀ-ɏ][a-zA-Z0-9_À-ɏ'-]+(?:\s+[A-Za-z0-9_À-ɏ'-]+)?)\b", False, "heuristics")
PATIENT_NARRATIVE = Pattern("patient_narrative", "PATIENT", 0.97, "stripped", rf"\b((?:Patient|Pt\.?)\s+)({_WORD}(?:\s+{_WORD}){{0,3}})(?=\s+[a-z]|\s*\(|\s*\||\s*\n|\s*;|\s*,|\s*\[|\s*\.|\s*$)", False, "heuristics")
PROVIDER_HEADER = Pattern("provider_header", "PROVIDER", 0.99, "stripped", r"\b((?:Att[a-z]*\s+[A-Za-z]+|ATTENDING(?:\s+[A-Z]+)?|CONSULTANT|RESIDENT|FELLOW|SURGEON|PHYSICIAN|PATHOLOGIST|DICTATED(?:\s+BY)?|DICTATOR|TRANSCRIBED(?:\s+BY)?|TRANSCRIPTIONIST|SIGNED(?:\s+BY)?|ELECTRONICALLY\s+SIGNED(?:\s+BY)?|CERTIFIED(?:\s+BY)?|ELECTRONICALLY\s+CERTIFIED(?:\s+BY)?|PROVIDER|NURSE|GENETIC\s+COUNSELOR|COUNSELOR|THERAPIST|PSYCHOLOGIST|AUDIOLOGIST|PHARMACIST|PHYSICIAN\s+SIGNATURE)[:\s]+(?:Dr\.?\s+)?)([A-ZÀ-ɏ][A-Za-z0-9_À-ɏ\.\s'-]{1,40}?)(?:,\s*(?:MD|DO|NP|RN|PA|MBBS|PhD|PsyD|FACS|FACP|CCP|RDCS|CEP|MS,\s*CEP|PA-C|CRNA|DPT|OTR/L|MSW|LCSW|CGC|MS,\s*CGC|MPH))?(?=\s*\(|\s*\||\s*\n|\s*;|\s*\.|\s*\[|\s*$)", True, "heuristics")
PROVIDER_TITLED = Pattern("provider_titled", "PROVIDER", 0.97, "whole", rf"\b(?:Dr\.?|Doctor)\s+(?:{_NAME})(?:,\s*(?:{_CREDENTIAL}))?\b|\b(?:{_NAME}),\s*(?:{_CREDENTIAL}|Attending|Resident|Fellow|Physician)\b", False, "heuristics")
FAMILY_HEADER = Pattern("family_header", "FAMILY", 0.98, "stripped", r"\b((?:Mother|Father|Brother|Sister|Son|Daughter|Child|Guardian|Legal\s+Guardians?|Stepfather|Stepmother|Stepson|Stepdaughter|Grandmother|Grandfather|Granddaughter|Grandson|Uncle|Aunt|Spouse|Husband|Wife|Cousin|Emergency\s+Contact)[:\s]+(?:(?:Mother|Father|Spouse|Husband|Wife|Sister|Brother|Son|Daughter|Guardian|Stepfather|Stepmother|Grandmother|Grandfather)\s+)?)([A-Za-z0-9_À-ɏ\.'\s-]+?)(?=\s+at\b|\s*\(|\s+and\b|\s*\||\s*\.|\s*,|\s*;|\s*\n|$)", True, "heuristics")
FAMILY_NARRATIVE = Pattern("family_narrative", "FAMILY", 0.96, "stripped", r"\b((?:daughter|son|mother|father|sister|brother|granddaughter|grandson|grandmother|grandfather|stepfather|stepmother|stepson|stepdaughter|spouse|husband|wife|cousin|niece|nephew|aunt|uncle)\s+)([A-Za-z0-9_À-ɏ'-]+(?:\s+[A-Za-z0-9_À-ɏ'-]+(?:-[A-Za-z0-9_À-ɏ'-]+)?))\b", True, "heuristics")
FACILITY_HEADER = Pattern("facility_header", "HOSPITAL", 0.97, "stripped", r"\b((?:FACILITY|TRANSFER\s+FACILITY|CLINIC|HOSPITAL|HEALTH\s+DEPT|LOCATION|SITE)[:\s]+)([A-Z][A-Za-z0-9\.'&, -]+?)(?=,\s*\d|\s*,\s*[A-Z]{2}\b|\s*\||\s*\n|\s*;|$)", True, "heuristics")
HOSPITAL = Pattern("hospital", "HOSPITAL", 0.96, "trimmed", r"\b(?:[A-Z][A-Za-z0-9\.'&, -]{2,60}?\s+(?:Hospital|Medical\s+Center|Health\s+System|Clinic|Infirmary|Memorial\s+Hospital|General\s+Hospital|Children's\s+Hospital|Regional\s+Medical\s+Center|Cancer\s+Pavilion|Cancer\s+Center|Hospital\s+Center|Cancer\s+Institute|Heart\s+Institute|Institute|Foundation|Senior\s+Living(?:\s+&\s+Subacute\s+Care)?|Subacute\s+Care|Hospice\s+Center|Hospice\s+Inpatient|Hospice\s+Pavilion|Rehabilitation\s+Center|Care\s+Center|Movement\s+Center|Orthopedic\s+Center|Psychiatric\s+Pavilion|Endoscopy\s+Suite|Surgery\s+Center|Center\s+for\s+[A-Z][a-z]+|Department\s+of\s+Public\s+Health|Trauma\s+Center|Elementary\s+School|High\s+School))\b|\b(?:Hospital\s+for\s+Special\s+Surgery)\b|\b(?:Mayo\s+Clinic\s+Hospital(?:\s*-\s*[A-Za-z ]+)?)\b", False, "gazetteer")
CITY = Pattern("city", "CITY", 0.95, "whole", r"\b(?:Palo\s+Alto|Oak\s+Park|Cambridge|Bethesda|Scottsdale|Evanston|New\s+York|Springfield|Memphis|Chicago|Boston|Seattle|Atlanta|Miami|Denver|Dallas|Houston|Phoenix|Philadelphia|San\s+Antonio|San\s+Diego|San\s+Jose|Austin|Jacksonville|San\s+Francisco|Indianapolis|Columbus|Charlotte|Detroit|El\s+Paso|Nashville|Baltimore|Oklahoma\s+City|Portland|Las\s+Vegas|Louisville|Milwaukee|Albuquerque|Tucson|Fresno|Sacramento|Mesa|Kansas\s+City|Cleveland|Virginia\s+Beach|Omaha|Oakland|Minneapolis|Tulsa|Arlington|New\s+Orleans|Wichita|Cleveland|Tampa|Bakersfield|Aurora|Honolulu|Anaheim|Santa\s+Ana|Corpus\s+Christi|Riverside|Lexington|St\.\s+Louis|Stockton|Pittsburgh|Cincinnati|Anchorage|Henderson|Greensboro|Plano|Newark|Lincoln|Orlando|Chula\s+Vista|Jersey\s+City|Chandler|Fort\s+Wayne|Buffalo|Durham|St\.\s+Petersburg|Irvine|Laredo|Lubbock|Madison|Gilbert|Norfolk|Reno|Winston-Salem|Glendale|Hialeah|Garland|Scottsdale|Irving|Chesapeake|North\s+Las\s+Vegas|Fremont|Baton\s+Rouge|Richmond|Boise|San\s+Bernardino|Spokane|Birmingham|Modesto|Des\s+Moines|Rochester|Tacoma|Fontana|Oxnard|Moreno\s+Valley|Fayetteville|Huntington\s+Beach|Yonkers|Glendale|Montgomery|Amarillo|Skokie|Belmont|Forest\s+Park)\b", True, "gazetteer")

#: Words that end a patient's name.
PATIENT_STOP_WORDS = ["has", "is", "was", "presents", "presented", "reported", "denies", "underwent", "admitted", "arrived", "complaining", "undergoing", "tolerated", "experienced", "noted", "stated", "showed", "developed", "diagnosed", "evaluated", "a", "an", "the"]
#: Parts of names that aren't looked for elsewhere.
NOT_PROPAGATED = ["the", "and", "male", "female", "year", "years", "old"]
#: Before a city's name: it is a person's.
BEFORE_CITY = r"(?U)\b(?:mr\.?|mrs\.?|ms\.?|dr\.?|doctor|patient|pt\.?)\s*$"
#: After a number of ninety or more: it is a dose or a result.
DOSE_UNIT = r"(?U)^(?:mg|mcg|ml|g|kg|units?|tabs?|capsules?|bpm|mmhg|%|k/ul|mg/dl|g/dl|meq)\b"

#: A phrase that counts time from another event.
RELATIVE = r"(?diuU)\b(?:post-operative\s+day\s+\d+|POD\s*#?\s*\d+|(?:\d+\s+)?(?:days?|weeks?|months?|years?|hours?)\s+(?:post-op|prior|ago|later|after|before|duration)|in\s+\d+\s+(?:days?|weeks?|months?|hours?)|for\s+(?:the\s+past\s+)?\d+\s+(?:days?|weeks?|months?|years?|hours?)|every\s+\d+\s+hours?|q\d+h|q\s*\d+\s*hours?|yesterday|today|tomorrow|post-op|pre-op|intra-op|x\s*\d+\s*(?:days?|weeks?|months?|hours?))\b"
#: An age of ninety or more.
AGE_90 = r"(?diuU)\b(?:(?:age\s*[:\s]*)?(?:9[0-9]|1[0-2][0-9])\s*(?:-|–|\s)?(?:yo|y/o|y\.o\.|yo/f|yo/m|yr\s+old|yrs\s+old|years?\s+old|-year-old|-yr-old)|(?:age|aged)\s+(?:9[0-9]|1[0-2][0-9])\b|\b(?:nonagenarian|centenarian)\b|\b(?:9[0-9]|1[0-2][0-9])(?:th|st|nd|rd)\s+birthday\b|\bturned\s+(?:9[0-9]|1[0-2][0-9])\b)"

#: Order in which detectors speak; ties between their spans keep it.
STRUCTURED = [SSN, MRN, PHONE, FAX, EMAIL, IPV4, IPV6, URL, MBI, HEALTHPLAN, ACCOUNT, NPI, DEA, LICENSE, VIN, PLATE, DEVICE, BIOMETRIC, PHOTO, ACCESSION, STREET, ZIP]

#: Which category a span keeps when two cover the same text; others have 50.
PRIORITY = {
    "PATIENT": 100, "PROVIDER": 95, "FAMILY": 90, "SSN": 85, "MRN": 85, "NPI": 85, "LICENSE": 85, "DATE": 80, "AGE": 75,
    "PHONE": 70, "FAX": 70, "EMAIL": 70, "HOSPITAL": 60, "ADDRESS": 50, "CITY": 40, "COUNTY": 30, "ZIP": 20, "DEVICE": 40,
    "VEHICLE": 40, "BIOMETRIC": 40, "PHOTO": 40, "ACCESSION": 40, "URL": 40, "IP": 40, "ACCOUNT": 40, "HEALTHPLAN": 40,
}

#: Categories that are one for tokens.
TOKEN_ALIASES = {"DOCTOR": "PROVIDER", "PHYSICIAN": "PROVIDER", "STREET": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "FACILITY": "HOSPITAL", "CLINIC": "HOSPITAL", "MEDICARE": "HEALTHPLAN", "MEDICAID": "HEALTHPLAN", "INSURANCE": "HEALTHPLAN", "CELL": "PHONE", "TELEPHONE": "PHONE"}

#: Words in brackets that are tokens of ours, and those that may be spelt loosely.
KNOWN_CATEGORIES = ["PATIENT", "PROVIDER", "DOCTOR", "PHYSICIAN", "FAMILY", "HOSPITAL", "FACILITY", "ADDRESS", "STREET", "CITY", "COUNTY", "STATE", "ZIP", "DATE", "AGE", "AGE_90+", "PHONE", "FAX", "EMAIL", "SSN", "MRN", "HEALTHPLAN", "ACCOUNT", "LICENSE", "NPI", "VEHICLE", "DEVICE", "URL", "IP", "BIOMETRIC", "PHOTO", "ACCESSION", "ID", "ORGANIZATION"]
FUZZY_TOKEN = r"(?diuU)(?:\[|\()\s*(PATIENT|PROVIDER|DOCTOR|PHYSICIAN|FAMILY|HOSPITAL|FACILITY|ADDRESS|STREET|CITY|COUNTY|STATE|ZIP|DATE|AGE|PHONE|FAX|EMAIL|SSN|MRN|HEALTHPLAN|ACCOUNT|LICENSE|NPI|VEHICLE|DEVICE|URL|IP|BIOMETRIC|PHOTO|ACCESSION|ID)[\s_]+([A-Za-z0-9_+-]+)\s*(?:\]|\))|\[\s*([A-Za-z0-9_+-]+)\s*\]"
BARE_TOKEN = r"(?dU)(?<!\[)\b(PATIENT_\d+|PROVIDER_[A-Za-z0-9]+|FAMILY_\d+|HOSPITAL_\d+|ADDRESS_\d+|CITY_\d+|COUNTY_\d+|ZIP_\d+|DATE_\d+|AGE_90\+_\d+|AGE_90\+|AGE_\d+|PHONE_\d+|FAX_\d+|EMAIL_\d+|SSN_\d+|MRN_\d+|HEALTHPLAN_\d+|ACCOUNT_\d+|LICENSE_\d+|NPI_\d+|VEHICLE_\d+|DEVICE_\d+|URL_\d+|IP_\d+|BIOMETRIC_\d+|PHOTO_\d+|ACCESSION_\d+|ID_\d+)\b(?!\])"
#: Tokens in the form in which they stay.
GIVEN_TOKEN = r"\[(?:(?:PATIENT|PROVIDER|FAMILY|HOSPITAL|ADDRESS|CITY|COUNTY|STATE|ZIP|DATE|PHONE|FAX|EMAIL|SSN|MRN|HEALTHPLAN|ACCOUNT|LICENSE|NPI|VEHICLE|DEVICE|URL|IP|BIOMETRIC|PHOTO|ACCESSION|ID)_[0-9]+|AGE_90\+(?:_[0-9]+)?)\]"
AGE_TWICE = [(r"(?diuU)(?=[\dnc])\b(\d+-(?:year-old|yr-old)|nonagenarian|centenarian)\s+(?:years?\s+old|yo|y/o|yr\s+old|yrs\s+old)\b", "$1"), (r"(?diuU)(?=\d)\b(\d+(?:th|st|nd|rd)\s+birthday)\s+birthday\b", "$1")]

#: Signs with which a pattern's matches can begin, as a class: most places are ruled out before the alternatives are tried.
FIRST = {
    "ssn": r"\d*s", "mrn": "mcpa", "phone": r"\d+(ptcm", "fax": "f", "ipv4": "0-9", "ipv6": "0-9a-fA-F", "mbi": "1-9", "healthplan": "bgipm", "account": "hbga", "npi": "n", "dea": "d", "vin": "v", "plate": "lptv",
    "device": "sudipl(", "biometric": "rfvdb", "street": r"\d", "zip": r"\d", "gps": r"l\d\-", "city_state_zip": "A-Z", "county": "A-Z", "date": r"\djfmasond", "age": "a91nct", "patient_header": "pibcns", "patient_honorific": "M",
    "patient_narrative": "P", "provider_header": "acrfspdteng", "provider_titled": "A-ZÀ-ɏ", "family_header": "mfbsdcgluahwe", "family_narrative": "dsmfbghwcnau", "facility_header": "ftchls", "hospital": "A-Z",
}

#: What a text must hold for a pattern to match, one of these: a string of the text's shape (in lower case, digits as 0, white space as blanks), `=` a word
#: of it (letters a to z between other signs), or `~` a pattern that the text in lower case matches. Most texts hold none, and a search for
#: a fixed string costs a hundredth of the pattern's.
_KIN = ["=mother", "=father", "=brother", "=sister", "=son", "=daughter", "=spouse", "=husband", "=wife", "=cousin", "=uncle", "=aunt", "=stepfather", "=stepmother", "=stepson", "=stepdaughter", "=grandmother", "=grandfather", "=granddaughter", "=grandson"]
_TEL = ["000-0000", "000.0000", "000 0000", "0000000"]
NEEDS = {
    "ssn": ["000-00-0000", "*-0000", "ssn"], "mrn": ["mrn", "mr#", "medical ", "chart ", "patient ", "account "], "phone": _TEL, "fax": ["fax", "facsimile", "fx"], "email": ["@"], "ipv4": ["0.0"],
    "ipv6": [r"~[0-9a-f]:(?::|[0-9a-f]{1,4}:)"], "url": ["http"], "mbi": ["0"],
    "healthplan": ["bcbs-", "grp-", "insur", "policy", "group", "member", "medicaid", "mbi"], "account": ["har", "billing", "guarantor", "account", "acct"], "npi": ["npi", "national "], "dea": ["dea"],
    "license": ["license", "dl", "md-", "rn-", "do-", "pa-", "psy-", r"~\b[a-z]{2}-[0-9]{5}"], "vin": ["vin", "vehicle"], "plate": ["plate", "tag"], "device": ["sn", "s/n", "serial", "udi", "device", "implant", "lot-", "(00)0"],
    "biometric": ["retinal", "fingerprint", "voiceprint", "dna", "biometric", "voice-bio"], "photo": [".jpg", ".jpeg", ".png", ".dicom", ".dcm", ".tiff", ".gif"],
    "accession": ["=accession", "=specimen", "=trial", "=subject", "=case", "=microarray", "=protocol", "=pathology", "barcode", *[f"={x}" for x in "ec lab acc spec path rad gen dna ct onc card neuro surg tx rx cma tb cpd chp ihc".split()]],
    "street": ["0 "], "zip": ["00000"], "gps": ["0.000"], "city_state_zip": [" 00000"],
    "county": ["=county"], "date": ["0"], "age": ["nonagenarian", "centenarian", "=turned", "=age", "=aged", r"~(?:9[0-9]|1[0-2][0-9])(?:\s*(?:-|–|\s)?-?y|(?:th|st|nd|rd)\s)"],
    "patient_header": [":", "#"], "patient_honorific": ["=mr", "=mrs", "=ms", "=miss"], "patient_narrative": ["patient ", "pt ", "pt. "],
    "provider_header": ["att", "consultant", "resident", "fellow", "surgeon", "physician", "pathologist", "dictat", "transcri", "signed", "certified", "provider", "nurse", "counselor", "therapist", "psychologist", "audiologist", "pharmacist"],
    "family_header": [*_KIN, "=child", "=guardian", "=legal", "=emergency"], "family_narrative": [*_KIN, "=niece", "=nephew"], "facility_header": ["=facility", "=clinic", "=hospital", "=health", "=location", "=site"],
    "hospital": ["=hospital", "=center", "=system", "=clinic", "=infirmary", "=institute", "=foundation", "=living", "=care", "=hospice", "=pavilion", "=suite", "=department", "=school"],
    "city": sorted({"=" + re.split(r"[^a-z]", c.lower())[0] for c in CITY.regex[5:-3].split("|")}),
}
