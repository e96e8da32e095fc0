"""Published synthetic cases of extraction: texts and the value of one field that each must give (None: no value)."""

# fixed values: the texts and expectations are those published with the extraction rules

#: field -> (case, text, expected value).
FIELD_CASES = {
    "clinic_address": [
        ("addr_label_direccion_single_line", "Clínica Veterinaria Norte\nDirección: Av. Norte 99, 28001 Madrid\nPaciente: Luna", "Av. Norte 99, 28001 Madrid"),
        ("addr_label_domicilio_single_line", "Centro Veterinario Sol\nDomicilio: Calle Alcalá 120, 28009 Madrid\nTel: 910000000", "Calle Alcalá 120, 28009 Madrid"),
        ("addr_label_dir_abbrev", "Hospital Veterinario del Sur\nDir.: C/ Mayor 45, 46001 Valencia\nNHC: 12345", "C/ Mayor 45, 46001 Valencia"),
        ("addr_label_multiline_cp_city_next_line", "Clínica: VetCare Centro\nDirección:\nCalle del Prado 18\n28014 Madrid\nPaciente: Kira", "Calle del Prado 18 28014 Madrid"),
        ("addr_label_multiline_with_floor", "Centro Veterinario Mirasierra\nDirección:\nAvda. de la Ilustración 22, 1º B\n28029 Madrid", "Avda. de la Ilustración 22, 1º B 28029 Madrid"),
        ("addr_unlabeled_header_then_address", "CLINICA SAN JORGE\nCalle Real 12, 09003 Burgos\nPaciente: Rocky", "Calle Real 12, 09003 Burgos"),
        ("addr_unlabeled_with_avenida", "Hospital Animalia\nAvenida de Europa 101, 28922 Alcorcón\nVeterinario: Dr. Ruiz", "Avenida de Europa 101, 28922 Alcorcón"),
        ("addr_abbrev_ctra", "Centro Vet Campo\nDirección: Ctra. de Toledo km 7, 45008 Toledo\nPaciente: Nilo", "Ctra. de Toledo km 7, 45008 Toledo"),
        ("addr_abbrev_pza_numero", "Clínica Felina Plaza\nDir.: Pza. España Nº 3, 1A, 41013 Sevilla", "Pza. España Nº 3, 1A, 41013 Sevilla"),
        ("addr_with_camino", "Hospital Vet Sierra\nDomicilio: Camino Viejo de Leganés 8, 28911 Leganés", "Camino Viejo de Leganés 8, 28911 Leganés"),
        ("addr_owner_address_should_not_be_clinic", "Propietario: Ana Pérez\nDirección del propietario: C/ Luna 5, 28080 Madrid\nClínica: Centro Vet Norte\nDirección de la clínica: Av. Moratalaz 10, 28030 Madrid", "Av. Moratalaz 10, 28030 Madrid"),
        ("addr_owner_only_should_be_null", "Propietario: Luis García\nDirección: C/ Falsa 123, 28080 Madrid\nPaciente: Toby\nEspecie: Canina", None),
        ("addr_null_no_address_present", "Paciente: Mía\nEspecie: Felina\nRaza: Europeo\nVet: Dra. López", None),
        ("addr_null_phone_and_email_only", "Clínica Vet Mar\nTeléfono: 934001122\nEmail: contacto@vetmar.es\nPaciente: Thor", None),
        ("addr_multiline_with_postal_code_prefix", "Centro Veterinario Costa\nDirección:\nPaseo Marítimo 77\nCP 29640 Fuengirola", "Paseo Marítimo 77 CP 29640 Fuengirola"),
        ("addr_unlabeled_ocrish_spacing", "HOSPITAL VETERINARIO AGORA\nC/   SAN   VICENTE   24 ,  03004   ALICANTE\nChip: 941000024967769", "C/ SAN VICENTE 24, 03004 ALICANTE"),
        ("addr_combined_clinic_direction_label", "Centro Veterinario / Dirección: C/ Mayor 45, 46001 Valencia\nPaciente: Nilo", "C/ Mayor 45, 46001 Valencia"),
        ("addr_header_block_with_postal_line", "PARQUE OESTE\nAVDA EUROPA\nLinea 4\n28922 ALCORCÓN\nDatos de la Mascota\nPaciente: Marley", "AVDA EUROPA Linea 4 28922 ALCORCÓN"),
    ],
    "clinic_name": [
        ("clinic_label_centro_simple", "Centro Veterinario: Clínica Norte\nPaciente: Luna", "Clínica Norte"),
        ("clinic_label_clinica_simple", "Clínica: VetSalud Madrid\nPaciente: Toby", "VetSalud Madrid"),
        ("clinic_label_hospital_simple", "Hospital Veterinario: Hospital Animalia\nPaciente: Kira", "Hospital Animalia"),
        ("clinic_with_tilde_and_punctuation", "Clínica: Centro Médico Veterinario Ágora.\nMicrochip: 941000024967769", "Centro Médico Veterinario Ágora"),
        ("clinic_with_hyphen_separator", "Clinica - VetCare Sur\nPropietario: Ana López", "VetCare Sur"),
        ("clinic_name_absent_should_be_null", "Paciente: Mía\nEspecie: Felina\nRaza: Europeo", None),
        ("address_line_not_clinic_name", "Dirección de la clínica: Av. Norte 99\nPaciente: Rocky", None),
        ("noise_word_clinica_not_label", "Animal activo y alerta. Corre por la clínica y salta.\nPaciente: Alya", None),
        ("multiline_header_value_next_line", "Centro Veterinario:\nClínica San Jorge\nPaciente: Nala", "Clínica San Jorge"),
        ("ocr_noisy_label_with_zero", "CENTR0 VETERINARI0: Vet Plus Sevilla\nPaciente: Max", "Vet Plus Sevilla"),
        ("clinic_label_with_extra_spaces", "Clínica   :    Hospital Vet Costa\nEspecie: Canina", "Hospital Vet Costa"),
    ],
    "dob": [
        ("dob_label_fecha_nacimiento_standard", "Paciente: Luna\nFecha de nacimiento: 15/03/2018\nEspecie: Canina", "15/03/2018"),
        ("dob_label_f_nac_short_year", "Nombre: Rex\nF. Nac.: 3/7/15\nSexo: Macho", "03/07/15"),
        ("dob_label_fnto_iso_format", "Paciente: Kira\nF/Nto: 2020-01-10\nRaza: Golden", "10/01/2020"),
        ("dob_label_nacimiento_dot_separator", "Nombre: Toby\nNacimiento: 08.12.2019\nPeso: 7 kg", "08/12/2019"),
        ("dob_label_nac_dash_separator", "Paciente: Max\nNac.: 22-06-2017\nEspecie: Canina", "22/06/2017"),
        ("dob_label_dob_english", "Patient: Milo\nDOB: 01/11/2021\nBreed: Labrador", "01/11/2021"),
        ("dob_label_fecha_nac_short", "Paciente: Nila\nFecha nac: 5/1/20\nChip: 941000024967769", "05/01/20"),
        ("dob_label_f_nac_dash_prefix", "Nombre: Thor\nF Nac - 30/04/2016\nSexo: Macho", "30/04/2016"),
        ("dob_ocr_noise_typo_fcha", "Paciente: Duna\nFcha nacimiento: 12/09/2019\nEspecie: Felina", "12/09/2019"),
        ("dob_ocr_double_space_label", "Nombre: Rocky\nFecha  de  nacimiento: 18/02/2020\nRaza: Mestiza", "18/02/2020"),
        ("dob_embedded_in_patient_block", "DATOS DEL PACIENTE\nNombre: Kira | Especie: Canina | Nac.: 25/11/2018 | Chip: 982000411223344", "25/11/2018"),
        ("dob_null_no_birthdate", "Paciente: Luna\nEspecie: Canina\nRaza: Golden\nSexo: Hembra", None),
        ("dob_null_visit_date_only", "Paciente: Max\nFecha de visita: 10/02/2024\nMotivo: Vacunación anual", None),
        ("dob_null_discharge_and_document_dates", "Paciente: Toby\nFecha documento: 01/03/2024\nAlta: 05/03/2024\nDiagnóstico: Otitis", None),
        ("dob_with_visit_date_distinct", "Paciente: Luna\nFecha de nacimiento: 15/03/2018\nFecha de visita: 10/02/2024\nMotivo: Revisión", "15/03/2018"),
        ("dob_null_only_consulta_unlabeled", "Paciente: Rex\nConsulta: 22/01/2025\nVeterinario: Dr. Pérez", None),
        ("dob_null_only_alta_unlabeled", "Paciente: Mía\nAlta: 05/03/2024\nTratamiento: Antibiótico", None),
        ("dob_multiline_label_and_value", "Paciente: Bimba\nFecha de nacimiento:\n20/07/2019\nEspecie: Felina", "20/07/2019"),
    ],
    "microchip_id": [
        ("chip_label_microchip_basic", "Paciente: Luna\nMicrochip: 941000024967769\nEspecie: Canina", "941000024967769"),
        ("chip_label_no_chip", "Nº chip: 982000411223344\nNombre: Rex\nSexo: Macho", "982000411223344"),
        ("chip_label_identificacion_electronica", "Identificación electrónica: 900123456789012\nPaciente: Kira", "900123456789012"),
        ("chip_label_transponder", "Transponder 100000123456789\nCentro: Vet Norte", "100000123456789"),
        ("chip_ocr_n_prefix_same_line", "Paciente LUNA\nN-941000024967769\nCanina", "941000024967769"),
        ("chip_with_spaces_and_dashes", "Chip: 941 0000-2496 7769\nPaciente: Max", "941000024967769"),
        ("chip_9_digits_min_length", "Microchip: 123456789\nPaciente: Nilo", "123456789"),
        ("chip_15_digits_max_length", "Nro chip 123456789012345\nEspecie: Felina", "123456789012345"),
        ("chip_two_values_prefers_labeled", "Teléfono: 912345678\nMicrochip: 941000024967769\nFactura: 20260304001", "941000024967769"),
        ("chip_null_owner_phone_only", "Propietario: Ana Pérez\nTeléfono: 612345678\nEmail: ana@example.com", None),
        ("chip_null_nif_present", "Titular: Luis García\nNIF: 12345678Z\nPaciente: Toby", None),
        ("chip_null_cp_and_phone", "Dirección: C/ Mayor 10, 28001 Madrid\nTel: 934001122\nPaciente: Mía", None),
        ("chip_null_short_8_digits", "Microchip: 12345678\nPaciente: Duna", None),
        ("chip_null_long_16_digits", "Microchip: 1234567890123456\nPaciente: Duna", None),
        ("chip_multiline_label_next_line", "Paciente: Thor\nNº Chip\n941000024967769\nEspecie: Canina", "941000024967769"),
        ("chip_microchip_colon_with_suffix", "Microchip: 941000024967769 (ISO 11784)\nCentro Vet Sur", "941000024967769"),
        ("chip_noise_but_keyword_present", "MICR0CHIP : 941000024967769\nPaciente: Bimba", "941000024967769"),
        ("chip_null_no_numeric_identifier", "Paciente: Rocky\nEspecie: Canina\nRaza: Mestiza", None),
    ],
    "owner_address": [
        ("owner_address_label_direccion_propietario_standard", "Propietario: Juan Garcia\nDireccion del propietario: Calle Mayor 12, 28013 Madrid\nPaciente: Luna", "Calle Mayor 12, 28013 Madrid"),
        ("owner_address_label_domicilio_propietario", "Datos del cliente\nDomicilio del propietario: Avenida de la Paz 44, 41001 Sevilla\nTelefono: 600123123", "Avenida de la Paz 44, 41001 Sevilla"),
        ("owner_address_context_owner_block", "DATOS DEL CLIENTE\nNombre: Marta Ruiz\nDireccion: Plaza del Sol 3, 46001 Valencia\nNIF: 12345678A", "Plaza del Sol 3, 46001 Valencia"),
        ("owner_address_abbrev_c_slash", "Titular: Beatriz Abarca\nDir. propietario: C/ Ortega y Gasset 5, 28006 Madrid\nPaciente: Nala", "C/ Ortega y Gasset 5, 28006 Madrid"),
        ("owner_address_abbrev_avda", "Propietario\nDireccion del titular: Avda. Libertad 102, 15004 A Coruna\nEmail: test@example.com", "Avda. Libertad 102, 15004 A Coruna"),
        ("owner_address_abbrev_pza_cp", "Datos propietario\nDomicilio: Pza. Castilla 8, CP 28046 Madrid\nMovil: 611222333", "Pza. Castilla 8, CP 28046 Madrid"),
        ("owner_address_multiline_two_lines", "Propietario: Lucia Torres\nDireccion del propietario:\nCalle Rio Duero 7\n28020 Madrid\nPaciente: Kira", "Calle Rio Duero 7\n28020 Madrid"),
        ("owner_address_mixed_name_plus_address", "Titular: Juan Garcia C/ Sol 9, 08002 Barcelona\nPaciente: Coco", "C/ Sol 9, 08002 Barcelona"),
        ("owner_address_label_dir_titular", "Ficha cliente\nDir. titular: Calle del Prado 11, 28014 Madrid\nTelefono: 699888777", "Calle del Prado 11, 28014 Madrid"),
        ("owner_address_label_dir_propietario_short", "Cliente\nDir. propietario: Avenida Europa 77, 29010 Malaga\nMascota: Thor", "Avenida Europa 77, 29010 Malaga"),
        ("owner_address_dual_owner_and_clinic_owner_wins", "Clinica Veterinaria Sol\nDireccion: Avenida Clinica 99, 03005 Alicante\nDatos del propietario\nDireccion: Calle Violeta 14, 03001 Alicante", "Calle Violeta 14, 03001 Alicante"),
        ("owner_address_ambiguous_context_owner_hint", "CLIENTE / TITULAR\nNombre: Pedro Marin\nDireccion: Calle Limon 21, 50002 Zaragoza\nPaciente: Misu", "Calle Limon 21, 50002 Zaragoza"),
        ("owner_address_null_no_owner_address_present", "Paciente: Luna\nEspecie: Canina\nRaza: Mestiza\nMicrochip: 941000024967769", None),
        ("owner_address_null_clinic_only_address", "Clinica Veterinaria Central\nDireccion de la clinica: Calle Salud 1, 28001 Madrid\nTelefono: 915000000", None),
        ("owner_address_null_ambiguous_without_owner_context", "Informe de consulta\nDireccion: Calle Consulta 55, 28010 Madrid\nVeterinario: Dra. Perez", None),
        ("owner_address_null_owner_label_but_no_address_tokens", "Propietario: Juan Ruiz\nDireccion del propietario: S/N\nPaciente: Lola", None),
        ("owner_address_null_owner_block_missing_value", "DATOS DEL PROPIETARIO\nNombre: Ana\nDireccion del propietario:\nTelefono: 655111222", None),
        ("owner_address_positive_domicilio_titular", "Titular del animal\nDomicilio del titular: Calle Norte 2, 33201 Gijon\nNIF: 55667788Z", "Calle Norte 2, 33201 Gijon"),
        ("owner_address_positive_context_line_after_label", "Datos cliente\nDireccion del propietario\nAvenida Mar 5, 35001 Las Palmas\nPaciente: Tiza", "Avenida Mar 5, 35001 Las Palmas"),
    ],
    "pet_name": [
        ("labeled_paciente_basic", "Paciente: Luna\nEspecie: Canina\nRaza: Mestiza", "Luna"),
        ("labeled_nombre_del_paciente", "Nombre del paciente: Rex\nSexo: Macho\nPeso: 22 kg", "Rex"),
        ("labeled_patient_en", "Patient: Buddy\nSpecies: Canine\nWeight: 18 kg", "Buddy"),
        ("labeled_with_trailing_birth", "Paciente: ALYA - Nacimiento: 05/07/2018\nChip:\n00023035139", "Alya"),
        ("unlabeled_uppercase_before_chip", "LUNA\nNº Chip\n941000024967769\nEspecie: Canina", "LUNA"),
        ("unlabeled_mixed_case_before_species", "Luna Bella\nEspecie/Raza: CANINA - YORKSHIRE TERRIER\nSexo: Hembra", "Luna Bella"),
        ("animal_label", "Animal: Kira\nMotivo de visita: Vómitos", "Kira"),
        ("mascota_label", "Mascota: Nilo\nEdad: 5 años\nPeso: 12,3 kg", "Nilo"),
        ("tabular_line", "Paciente | Thor | Canino\nRaza | Labrador", "Thor"),
        ("diacritics_name", "Paciente: Ñoño\nEspecie: Felina", "Ñoño"),
        ("roman_suffix", "Paciente: Rex III\nEspecie: Canina", "Rex III"),
        ("negative_numeric_only", "Paciente: 12345\nEspecie: Canina\nPeso: 8 kg", None),
        ("negative_empty_label", "Paciente:\nEspecie: Canina\nRaza: Beagle", None),
        ("negative_header_word_only", "NOMBRE\nEspecie: Canina\nRaza: Mestiza", None),
        ("negative_paciente_multiline_bullet_treatment", "PACIENTE:\n- STEROVET A VELOCIDAD DE MANTENIMIENTO\nTratamiento: Prednicortone", None),
        ("negative_no_pet_name_present", "Fecha: 04/10/19\nNº Chip\n941000024967769\nC/ CALLE DEMO 1 PORTAL 3 1F\nVet gastril 6ml cada 24h", None),
    ],
    "weight": [
        ("multi_visit_two_weights_latest_should_win", "Visita 15/01/2026: Peso: 8.2 kg. Evolucion favorable. Visita 22/01/2026: Peso: 8.5 kg. Continuar control.", "8.5 kg"),
        ("global_header_only_weight", "Paciente: Nala. Especie: Canina. Peso: 12 kg. Vacunacion al dia.", "12 kg"),
        ("multi_visit_signos_vitales_and_labeled_weight", "Consulta 10/02/2026. Signos vitales: FC 110 lpm, FR 24 rpm, 25.5 kg. Consulta 03/03/2026. Peso: 26 kg.", "26 kg"),
        ("dose_mlkg_should_not_override_weight", "Dosis: 0.5 ml/kg cada 12h. Visita 01/01/2026: Peso: 4.2 kg.", "4.2 kg"),
        ("multi_visit_without_weight", "Visita 11/01/2026: Diagnostico de gastritis. Visita 18/01/2026: Control clinico, sin datos de peso.", None),
        ("one_visit_with_weight_other_without", "Visita 08/02/2026: Diagnostico de dermatitis. Visita 20/02/2026: Peso: 9.1 kg.", "9.1 kg"),
    ],
}

#: (case, text, dates of its visits).
VISIT_CASES = [
    ("visit_explicit_keywords_two_visits", "Consulta 11/02/2026: dolor de oido.\nVisita 18/02/2026: control y ajuste de medicacion.", ["2026-02-11", "2026-02-18"]),
    ("visit_implicit_keywords_two_visits", "Atencion 01/03/2026 por prurito.\nRevision 15/03/2026 con mejoria clinica.", ["2026-03-01", "2026-03-15"]),
    ("visit_section_separator_blocks", "=== VISITA ===\nFecha: 10/01/2026\nMotivo: cojeras\n---\n=== CONTROL ===\nFecha: 24/01/2026\nMotivo: seguimiento", ["2026-01-10", "2026-01-24"]),
    ("visit_dates_without_visit_keyword", "11/02/2026: se imprime informe administrativo.\n18/02/2026: emision de factura.", []),
    ("visit_mixed_date_formats", "Consulta 11/02/2026 por otitis.\nControl 2026-02-18 con respuesta parcial.\nCita 01-03-2026 para reevaluacion.", ["2026-02-11", "2026-02-18", "2026-03-01"]),
    ("visit_single_visit_control", "Consulta 11/02/2026: examen general y tratamiento inicial.", ["2026-02-11"]),
    ("visit_duplicate_formats_same_visit", "Visita 18/02/2026: control.\nEn cabecera: fecha de consulta 2026-02-18.", ["2026-02-18"]),
]
