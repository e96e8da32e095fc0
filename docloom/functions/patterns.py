"""The label patterns, anchors and word lists that extraction reads by. Patterns are for Java's regular expressions."""

NUMERIC_DATE = r"[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}"
ANY_DATE = rf"\b(?:{NUMERIC_DATE}|[0-9]{{4}}[/\-.][0-9]{{1,2}}[/\-.][0-9]{{1,2}})\b"

#: (key, pattern with the value as group 1), in the order in which they are read; all without regard to case.
LABELLED = (
    ("pet_name", r"(?:paciente|nombre(?:\s+del\s+(?:paciente|animal))?|patient|animal|mascota|nombre\s+mascota)\s*[:\-|][ \t]*(?:\n[ \t]*)?([A-Za-zÁÉÍÓÚÜÑáéíóúüñ][^\n;|]{1,99})"),
    ("species", r"(?:especie\s*/\s*raza|raza\s*/\s*especie)\s*[:\-]\s*([^\n;]{2,120})"),
    ("breed", r"(?:especie\s*/\s*raza|raza\s*/\s*especie)\s*[:\-]\s*([^\n;]{2,120})"),
    ("species", r"(?:especie|species)\s*[:\-]\s*([^\n;]{2,80})"),
    ("breed", r"(?:raza|breed)\s*[:\-]\s*([^\n;]{2,80})"),
    ("sex", r"(?:sexo|sex)\s*[:\-]\s*([^\n;]{1,40})"),
    ("age", r"(?:edad|age)\s*[:\-]\s*([^\n;]{1,60})"),
    ("dob", rf"(?:f\.\s*nac\.?|fcha\s+(?:de\s+)?nacimiento|f(?:echa)?\s*(?:de\s*)?(?:nacimiento|nac\.?|nac|nto)|f[/\s]?nto|fnto|nacimiento|dob|birth\s*date|fecha\s*nac)\s*[:\-]?\s*({NUMERIC_DATE}|[0-9]{{4}}[/\-.][0-9]{{1,2}}[/\-.][0-9]{{1,2}})"),
    ("weight", r"(?:peso(?:\s+corporal)?|weight|peso\s*\(\s*kg\s*\)|p\.(?!\s*ej\.?\b))\s*[:\-]?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:kg|kgs|g)?)"),
    ("weight", r"(?:signos?\s+vitales\s*[:\-]?\s*(?:\n\s*)?)(?:peso(?:\s+corporal)?|weight|p\.(?!\s*ej\.?\b))?\s*[:\-]?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:kg|kgs|g)\b)"),
    ("weight", r"(?:datos\s+de\s+la\s+mascota|datos\s+del\s+paciente|paciente|mascota|especie|raza|sexo|n[º°o]?\s*chip)\b[^\n]{0,90}?([0-9]+(?:[.,][0-9]+)?\s*(?:kg|kgs|g)\b)"),
    ("microchip_id", r"(?:microchip|micr0chip|chip|transponder|identificaci[oó]n\s+electr[oó]nica)\s*(?:n[ºo°�]\.?|nro\.?|id)?\s*[:\-]?\s*([A-Za-z0-9][A-Za-z0-9./_\-]{1,30}(?:\s+[A-Za-z0-9][A-Za-z0-9./_\-]{0,20}){0,3})"),
    ("clinical_record_number", r"(?:nhc|n[ºo°]?\s*(?:historial|historia\s*cl[ií]nica)|historial\s*cl[ií]nico|n[uú]mero\s*de\s*historial)\s*[:\-]?\s*([A-Za-z0-9./_\-]{2,40})"),
    ("visit_date", rf"(?:fecha\s+de\s+visita|visita|consulta|visit\s+date)\s*[:\-]\s*({NUMERIC_DATE})"),
    ("document_date", rf"(?:fecha\s+documento|fecha|date)\s*[:\-]\s*({NUMERIC_DATE})"),
    ("clinic_name", r"(?m)^\s*(?:cl[ií]nica|centro\s+veterinari[oa]|hospital\s+veterinari[oa]|centr0\s+veterinari0)\s*[:\-|]\s*(?:\n\s*)?([^\n;]{3,120})"),
    ("clinic_address", r"(?:direcci[oó]n\s*(?:de\s*la\s*cl[ií]nica)?|domicilio\s*(?:de\s*la\s*cl[ií]nica)?)\s*[:\-]\s*([^\n;]{4,160})"),
    ("vet_name", r"(?:veterinari[oa]|dr\.?|dra\.?)\s*[:\-]\s*([^\n;]{3,120})"),
    ("owner_name", r"(?:propietari[oa]|tutor)\s*[:\-]\s*([^\n;]{3,120})"),
    ("owner_address", r"(?:direcci[oó]n\s+del\s+(?:propietari[oa]|titular)|domicilio\s+del\s+(?:propietari[oa]|titular)|dir\.\s*(?:propietari[oa]|titular))\s*[:\-]\s*([^\n;]{4,160})"),
    ("coat_color", r"(?:capa|color\s*(?:del\s*(?:pelaje|pelo))?)\s*[:\-]\s*([^\n;]{2,100})"),
    ("hair_length", r"(?:pelo|longitud\s*del\s*pelo)\s*[:\-]\s*([^\n;]{2,100})"),
    ("repro_status", r"(?:estado\s*reproductivo|repro(?:ductivo)?|esterilizad[oa]|castrad[oa]|f[eé]rtil)\s*[:\-]\s*([^\n;]{2,80})"),
    ("reason_for_visit", r"(?:motivo(?:\s+de\s+consulta)?|reason\s+for\s+visit)\s*[:\-]\s*([^\n]{3,200})"),
)

#: The letters with which a match of each of these patterns can begin, without regard to case; '' where it may begin with white space.
LABEL_STARTS = ("pnam", "er", "er", "es", "rb", "s", "ea", "fndb", "pw", "s", "dpmersn", "mcti", "nh", "fvc", "fd", "", "d", "vd", "pt", "d", "c", "pl", "ercf", "mr")
#: The places in the table of the labels that windows of chip numbers and of record numbers begin with.
CHIP_RULE, RECORD_RULE = 11, 12

#: Words near a date that say what it is the date of, and how much they count; birth words count least and never win.
DATE_ANCHORS = (
    ("visit_date", 4, ("visita", "consulta", "revision", "revisión", "control", "urgencia")),
    ("document_date", 2, ("fecha documento", "documento", "informe", "historial", "fecha")),
    ("admission_date", 3, ("admisión", "admision", "ingreso", "hospitaliza")),
    ("discharge_date", 3, ("alta", "egreso")),
)

CHIP_LABEL = r"(?iu)\b(?:microchip|micr0chip|chip|transponder|identificaci[oó]n\s+electr[oó]nica|n[º°o]?\s*chip)\b"
CHIP_WINDOW = r"(?iu)(?=[mctin])(?:microchip|micr0chip|chip|transponder|identificaci[oó]n\s+electr[oó]nica|n[ºo°�]\s*chip)\s*(?:n[ºo°�]\.?|nro\.?|id)?\s*[:\-]?\s*([^\n]{0,90})"
CHIP_OCR_WINDOW = r"(?iu)\bn(?:[º°�]|ro)?\.?\s*[:\-]\s*([^\n]{0,60})"
RECORD_WINDOW = r"(?iu)(?=[nh])(?:nhc|n[ºo°]?\s*(?:historial|historia\s*cl[ií]nica)|historial\s*cl[ií]nico)\s*[:\-]?\s*([^\n]{1,60})"

#: Words of a line's label, and the keys that its value goes to.
CLINICAL_LABELS = (
    ("diagnosis", ("diagn", "impresi")),
    ("medication", ("trat", "medic", "prescrip", "receta")),
    ("treatment_plan", ("trat", "medic", "prescrip", "receta")),
    ("procedure", ("proced", "interv", "cirug", "quir")),
    ("symptoms", ("sintom", "symptom")),
    ("vaccinations", ("vacun", "vaccin")),
    ("lab_result", ("laboratorio", "analit", "lab")),
    ("imaging", ("radiograf", "ecograf", "imagen", "tac", "rm")),
    ("line_item", ("linea", "concepto", "item")),
)
#: Words anywhere in a line that make the whole line a value; the first needs a line without a colon.
CLINICAL_WORDS = (
    ("diagnosis", ("diagn", "impresi")),
    ("medication", ("amoxic", "clavul", "predni", "omepra", "antibiot", "mg", "cada")),
    ("procedure", ("cirug", "proced", "sut", "cura", "ecograf", "radiograf")),
)

WEIGHT_EXPLICIT = r"(?iu)\b(?:peso(?:\s+corporal)?|weight|signos?\s+vitales|p\.(?!\s*ej\.?\b))\b"
WEIGHT_GUARD = r"(?iu)\b(?:ml|mg)\s*/\s*kg\b|\b(?:mg\s*/\s*dL|mmol\s*/\s*L|U\s*/\s*L)\b|\$|€|\bEUR\b"
WEIGHT_OTHER = r"(?iu)\b(?:dosis|tratamiento|medicaci[oó]n|prescripci[oó]n|amoxic|clavul|predni|omepra|anal[ií]tica|laboratorio|hemograma|bioqu[ií]mica|glucosa|urea|creatinina|mg\s*/\s*kg|ml\s*/\s*kg|mg\s*/\s*dL|mmol\s*/\s*L|U\s*/\s*L)\b"
WEIGHT_LINE = r"(?iu)^\s*(?:peso|pv|p\.)?\s*([0-9]+(?:[.,][0-9]+)?)\s*(kg|kgs|g)\.?\s*$"
VISIT_TIMELINE = r"(?iu)\b(?:visita|consulta|control|seguimiento|ingreso|alta)\b"

OWNER_CONTEXT = r"(?iu)\b(?:propietari(?:o|a)|titular|dueñ(?:o|a)|owner|tutor)\b"
OWNER_ADDRESS_CONTEXT = r"(?iu)\b(?:propietari[oa]|titular|dueñ(?:o|a)|owner|tutor|datos\s+del\s+cliente|cliente)\b"
CLINIC_ADDRESS_CONTEXT = r"(?iu)\b(?:cl[ií]nica|hospital|centro\s+veterinario|veterinari[oa]|vet\b|dr\.?|dra\.?|doctor(?:a)?)\b"
VET_OR_CLINIC = r"(?iu)\b(?:veterinari[oa]|vet\b|doctor(?:a)?\b|dra\.?\b|dr\.?\b|cl[ií]nica|hospital|centro\s+veterinario)\b"
ADDRESS_LIKE = r"(?iu)(?:\b(?:c/|calle|av\.?|avenida|cp\b|portal|piso|puerta)\b|\d+\s*(?:[,\-]|$))"
ADDRESS_SPLIT = r"(?iu)\b(?:c/|calle|av\.?|avenida|cp\b|n[º°o]\.?|num\.?|número|plaza|pte\.?|portal|piso|puerta)\b"
STREET_START = r"(?iu)(?:^|\s)(?:c/\s*|calle\b|avda?\.?\b|avenida\b|plaza\b|pza\.?\b|paseo\b|camino\b|carretera\b|ctra\.?\b)"
GENERIC_ADDRESS_LABEL = r"(?iu)\b(?:direcci[oó]n|domicilio|dir\.?)\s*[:\-]"
CLINIC_ADDRESS_LABEL = r"(?iu)\b(?:direcci[oó]n|domicilio)\s+de\s+la\s+cl[ií]nica\b"
NAME_TOKEN = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'.\-]*$"

PET_BIRTH_LINE = r"(?iu)^\s*([A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'\-\s]{1,40}?)\s*[-–—]\s*(?:nacimiento|nac\.?|dob|birth(?:\s*date)?)(?!\w)"
PET_GUARD = r"(?iu)\d{3,}|^[A-Z]{2,3}\d|calle|avda|portal|telf|tel[eé]f|c/|direc"
CLINIC_IN_LINE = r"(?iu)\b(?:en\s+el|en\s+la)\s+(centr[o0]|cl[ií]nica|hospital(?:\s+veterinari[oa])?)\s+([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9][^\n,;]{2,100})"
CLINIC_LINE = r"(?iu)^\s*(hv|h\.?\s*v\.?|hospital(?:\s+veterinari[oa])?|centro(?:\s+veterinari[oa])?|cl[ií]nica(?:\s+veterinari[oa])?)\s+([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9][^\n,;:]{2,100})\s*$"

VET_LABEL = r"(?iu)^\s*(?:veterinari(?:o|a|o/a)|vet|dr\.?|dra\.?|dr/a|doctor|doctora)\b\s*[:\-]?\s*(.*)$"
OWNER_LABEL = r"(?iu)^\s*(?:propietari(?:o|a)|titular|dueñ(?:o|a)|owner)\b\s*[:\-]?\s*(.*)$"
OWNER_NAME_LABEL = r"(?iu)^\s*nombre\s*(?::|-)?\s*(.*)$"
CLIENT_HEADER = r"(?iu)^\s*datos\s+del\s+cliente\s*$"
CLIENT_TABLE_LABEL = r"(?iu)^\s*(?:especie|raza|f/?nto|capa|n[º°o]?\s*chip)\s*$"
PATIENT_LABEL = r"(?iu)\bpaciente\b\s*[:\-]"
LICENSE_ONLY = r"(?iu)^\s*(?:col(?:egiad[oa])?\.?|n[º°o]?\s*col\.?|lic(?:encia)?\.?|cmp\.?|nif\b|dni\b)\s*[:\-]?\s*[A-Za-z0-9\-./\s]{3,}$"
PHONE_LIKE = r"\+?\d[\d\s().-]{6,}"
#: A person's name ends where one of these words begins an address.
ADDRESS_WORDS = ("calle", "av", "avenida", "cp", "codigo postal", "no", "nº", "n°", "num", "número", "plaza", "pte", "portal", "piso", "puerta")
SIMPLE_LABEL = r"^[^\n]{1,40}\s*[:\-]\s*"
POSTAL_HINT = r"(?iu)\b(?:cp\b|c[oó]digo\s+postal|\d{5})\b"
HEADER_ADDRESS = r"(?iu)\b(?:avda?\.?|avenida|calle|c/|portal|piso|puerta|codigo\s+postal|cp\b)|\b\d{5}\b"
HEADER_SECTION = r"(?iu)\b(?:datos\s+de\s+la\s+mascota|datos\s+del\s+cliente|especie|raza|n[º°o]\s*chip)\b"
HEADER_WORDS = ("HISTORIAL", "INFORME", "FICHA", "DATOS", "CLIENTE", "NOMBRE", "ESPECIE", "RAZA", "SEXO", "CHIP", "VISITA", "FECHA", "PACIENTE", "PROPIETARIO", "PROPIETARIA", "VETERINARIO", "VETERINARIA", "DIAGNÓSTICO", "DIAGNOSTICO", "TRATAMIENTO", "MEDICACIÓN", "MEDICACION", "VACUNACIÓN", "VACUNACION")
CLINIC_ADDRESS_LINE = r"(?iu)^\s*(?:(?:centro|cl[ií]nica|hospital)(?:\s+veterinari[oa])?\s*/\s*)?(direcci[oó]n(?:\s+de\s+la\s+cl[ií]nica)?|domicilio(?:\s+de\s+la\s+cl[ií]nica)?|dir\.?)\s*(?:[:\-]\s*(.*))?$"
GENERIC_ADDRESS_LINE = r"(?iu)^\s*(?:direcci[oó]n|domicilio|dir\.?)\s*(?:[:\-]\s*(.*))?$"
OWNER_ADDRESS_LINE = r"(?iu)^\s*(?:direcci[oó]n\s+del\s+(?:propietari[oa]|titular)|domicilio\s+del\s+(?:propietari[oa]|titular)|dir\.?\s*(?:propietari[oa]|titular))\s*(?:[:\-]\s*(.*))?$"
CLINIC_CONTEXT = r"(?iu)\b(?:cl[ií]nica|centro|hospital|veterinari[oa]|vet)\b"
OWNER_HEADER = r"(?iu)\b(?:propietari[oa]|titular|dueñ(?:o|a)|owner|cliente|tutor)\b"
NAME_LINE = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'.\-]*(?:\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'.\-]*){1,4}$"
LOCALITY_LINE = r"^[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑ\s'.\-]{1,40}$"
LOCALITY_NOT = ("historial", "plan", "exploracion", "exploración", "tratamiento", "diagnostico", "diagnóstico")
IDENTIFICATION = r"(?iu)\b(?:n[º°o]\s*chip|chip|microchip|paciente|mascota|especie|raza|sexo)\b"

CLINIC_NAME_LABEL = r"(?iu)^(?:cl[ií]nica|centro\s+veterinari[oa]|hospital\s+veterinari[oa])\s*[:\-|]\s*"
CLINIC_ADDRESS_LEAD = r"(?iu)^(?:direcci[oó]n(?:\s+de\s+la\s+cl[ií]nica)?|domicilio(?:\s+de\s+la\s+cl[ií]nica)?|dir\.?)\s*[:\-]\s*"
OWNER_ADDRESS_LEAD = r"(?iu)^(?:direcci[oó]n|domicilio|dir\.?)(?:\s+(?:(?:de(?:l)?)\s+)?(?:propietari[oa]|titular))?\s*[:\-]?\s*"
CLINIC_ABBREVIATIONS = ((r"(?iu)\bc/\s*", "Calle "), (r"(?iu)\bavda\.?(?=\s|$)", "Avenida"), (r"(?iu)\bpza\.?(?=\s|$)", "Plaza"), (r"(?iu)\bctra\.?(?=\s|$)", "Carretera"), (r"(?iu)\bn[º°o]\.?(?=\s|\d)", "Número"))
OWNER_ABBREVIATIONS = ((r"(?iu)\bc/\s*", "Calle "), (r"(?iu)\bavda\.?(?=\s|$)", "Avenida"), (r"(?iu)\bav\.?(?=\s|$)", "Avenida"), (r"(?iu)\bpza\.?(?=\s|$)", "Plaza"), (r"(?iu)\bcp\b", "C.P."))
OWNER_ADDRESS_WORD = r"(?iu)\b(?:calle|avenida|plaza|carretera|camino|paseo|barrio|urbanizaci[oó]n|c\.?p\.?|codigo\s+postal|portal|piso|puerta|bloque|escalera|km|kil[oó]metro|n[º°o]?|num(?:ero)?|c/)\b"
OWNER_ADDRESS_OTHER = r"(?iu)\b(?:propietari[oa]|titular|cliente|nombre|tel[eé]fono|telefono|email|dni|nif)\b"

VISIT_DATE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
#: What every such date holds; as a pattern much faster on texts without any.
VISIT_DATE_CORE = r"[0-9][-/.][0-9]"
VISIT_CONTEXT = r"(?iu)\b(?:visita|consulta|control|revisi[oó]n|seguimiento|ingreso|alta)\b"
VISIT_LABEL = r"(?iu)\bfecha\s+de\s+(?:visita|consulta|cita|atenci[oó]n|exploraci[oó]n|control)\b"
VISIT_CLINICAL = r"(?iu)\b(?:revisar|reevaluar|tratamiento|medicaci[oó]n|exploraci[oó]n|seguimiento)\b"
VISIT_TIMELINE_LINE = r"(?iu)^\s*[-*•]?\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\s*[-–—]\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*[-–—]\s*.*)?$"
VISIT_DAY_LINE = r"(?iu)\bd[ií]a\s+\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"
TIMELINE_HEADER = r"^\s*[-*•]?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\s*[-–—]\s*\d{1,2}:\d{2}(?::\d{2})?"
WEIGHT_TOKEN = r"(?i)\b(?:peso|pv|p\.)?\s*([0-9]+(?:[.,][0-9]+)?)\s*(kgs?|g)\b"
VISIT_BOUNDARY = r"(?iu)visita\s+(?:consulta\s+general|administrativa)\s+del\s+d[ií]a"
NOT_VISIT = r"(?iu)\b(?:nacimiento|dob|microchip|chip|factura|invoice|emisi[oó]n|documento|dni|nif|pasaporte|id\b|identificaci[oó]n|lote|referencia|presupuesto|an[aá]lisis|laboratorio|orina|coprol[oó]gico|documentos?\s+pdf)\b"

#: Keys that every visit has, and keys of fields that belong to visits.
VISIT_META = ("visit_date", "admission_date", "discharge_date", "reason_for_visit")
VISIT_KEYS = ("observations", "actions", "symptoms", "diagnosis", "procedure", "medication", "treatment_plan", "allergies", "vaccinations", "lab_result", "imaging", "weight")
#: A folded text with one of these words is in Spanish.
SPANISH_HINTS = ("paciente", "diagnost", "tratamiento")

#: The canonical record: (key, section, type, repeatable, critical) in order.
CONTRACT = (
    ("claim_id", "case", "string", False, False), ("clinic_name", "case", "string", False, False), ("clinic_address", "case", "string", False, False), ("vet_name", "case", "string", False, False), ("document_date", "case", "date", False, False),
    ("pet_name", "patient", "string", False, True), ("species", "patient", "string", False, True), ("breed", "patient", "string", False, True), ("sex", "patient", "string", False, True), ("age", "patient", "string", False, True), ("dob", "patient", "date", False, False), ("microchip_id", "patient", "string", False, False), ("weight", "patient", "string", False, True),
    ("owner_name", "owner", "string", False, False), ("owner_id", "owner", "string", False, False), ("owner_address", "owner", "string", False, False),
    ("visit_date", "visit", "date", False, True), ("admission_date", "visit", "date", False, False), ("discharge_date", "visit", "date", False, False), ("reason_for_visit", "visit", "string", False, False), ("observations", "visit", "string", False, False), ("actions", "visit", "string", False, False),
    ("diagnosis", "clinical", "string", True, True), ("symptoms", "clinical", "string", True, False), ("procedure", "clinical", "string", True, True), ("medication", "clinical", "string", True, True), ("treatment_plan", "clinical", "string", False, False), ("allergies", "clinical", "string", False, False), ("vaccinations", "clinical", "string", True, False), ("lab_result", "clinical", "string", True, False), ("imaging", "clinical", "string", True, False),
    ("invoice_total", "cost", "string", False, False), ("covered_amount", "cost", "string", False, False), ("non_covered_amount", "cost", "string", False, False), ("line_item", "cost", "string", True, False),
    ("notes", "metadata", "string", False, False), ("language", "metadata", "string", False, False),
)

#: What a text must hold for any rule above to find something in it: one of these words, folded, or one of these patterns. A text without is never split.
HINT_WORDS = (
    "paciente", "nombre", "patient", "animal", "mascota", "especie", "raza", "species", "breed", "sex", "edad", "age", "peso", "weight", "vitales", "chip", "transponder", "identificaci", "nhc", "historia",
    "clinica", "clínica", "centro", "centr0", "hospital", "direcci", "domicilio", "dir.", "veterinari", "propietari", "tutor", "titular", "dueñ", "owner", "cliente", "capa", "color", "pelo", "repro", "esteriliz", "castrad", "fertil", "fértil", "motivo", "reason",
    "macho", "male", "hembra", "canin", "felin", "perro", "perra", "gato", "gata", "nac", "birth", "calle", "c/", "avda", "avd.", "avenida", "plaza", "pza", "paseo", "camino", "carretera", "ctra",
    "diagnost", "tratamiento",
    *(w for _, words in CLINICAL_LABELS + CLINICAL_WORDS for w in words if len(w) > 3), "cada", "cura", "mg", "sut",
)
#: Shapes that count without a word: dates, weights, short labels; and what a line may begin with. For Python's regular expressions, on a folded text; each shape
#: begins with a character or class, to which a search skips.
HINT_SHAPES = (r"[0-9](?:[/\-.][0-9]|\s*k?gs?\b)", r"p\.\s*(?:[:\-]\s*)?[0-9]", r"dra?\.?\s*[:\-]", r"n(?<!\wn)(?:[º°�]|ro)?\.?\s*[:\-]")
HINT_LINE_STARTS = r"(?:vet|dra?|dr/a|doctora?|h\.?\s*v|dir)\b"
#: These count only in a text with a colon or a hyphen.
HINT_LABELS = ("lab", "tac", "rm")
#: For each pattern of the label table, words of which one is in whatever it matches, folded. Only texts with such a word are matched.
LABEL_CUES = (
    ("paciente", "nombre", "patient", "animal", "mascota"), ("especie",), ("especie",), ("especie", "species"), ("raza", "breed"), ("sex",), ("edad", "age"), ("nac", "nto", "dob", "birth"),
    ("peso", "weight", "p."), ("vitales",), ("datos", "paciente", "mascota", "especie", "raza", "sexo", "chip"), ("chip", "transponder", "identificaci"), ("nhc", "histori"), ("visit", "consulta"), ("fecha", "date"),
    ("clinica", "clínica", "centro", "centr0", "hospital"), ("direcci", "domicilio"), ("veterinari", "dr"), ("propietari", "tutor"), ("direcci", "domicilio", "dir."), ("capa", "color"), ("pelo",),
    ("repro", "esterilizad", "castrad", "fertil", "fértil"), ("motivo", "reason"),
)
