"""Rows of the small market of foods that the tests of the lakehouse use."""

# A small market of foods: (id, name, group, marked cells by column). Cells not named hold '1'.
FOODS = [
    (1, "Arroz, tipo 1, cozido", "Cereais e derivados", {"proteina_g": "2.5", "lipideos_g": "0.2", "carboidrato_g": "28.1", "energia_kcal": "128", "calcio_mg": "4", "vitamina_c_mg": "NA"}),
    (2, "Aveia, flocos, crua", "Cereais e derivados", {"proteina_g": "13.9", "lipideos_g": "8.5", "carboidrato_g": "66.6", "energia_kcal": "394", "calcio_mg": "48", "vitamina_c_mg": "1.4"}),
    (3, "Arroz, integral, cozido", "Cereais e derivados", {"proteina_g": "2.6", "lipideos_g": "1.0", "carboidrato_g": "27.4", "energia_kcal": "124", "tiamina_mg": "Tr"}),
    (4, "Laranja, pêra, crua", "Frutas e derivados", {"proteina_g": "1.0", "lipideos_g": "0.1", "carboidrato_g": "8.9", "energia_kcal": "37", "vitamina_c_mg": "53.7", "calcio_mg": "22"}),
    (5, "Acerola, crua", "Frutas e derivados", {"proteina_g": "0.9", "lipideos_g": "0.2", "carboidrato_g": "8", "energia_kcal": "33", "vitamina_c_mg": "941.4", "calcio_mg": "13", "tiamina_mg": "0.02"}),
    (6, "Carne, bovina, fígado, cru", "Carnes e derivados", {"proteina_g": "20.7", "lipideos_g": "5.4", "carboidrato_g": "1.1", "energia_kcal": "141", "ferro_mg": "5.6", "niacina_mg": "0"}),
    (7, "Frango, fígado, cru", "Carnes e derivados", {"proteina_g": "17.6", "lipideos_g": "3.5", "carboidrato_g": "0", "energia_kcal": "106", "ferro_mg": "9.5", "zinco_mg": "*"}),
    (8, "Óleo, de soja", "Gorduras e óleos", {"proteina_g": "NA", "lipideos_g": "100", "carboidrato_g": "NA", "energia_kcal": "884"}),
    (9, "Azeite, de oliva", "Gorduras e óleos", {"proteina_g": "NA", "lipideos_g": "100", "carboidrato_g": "NA", "energia_kcal": "884"}),
    (10, "Leite, de vaca, integral", "Leite e derivados", {"proteina_g": "3.2", "lipideos_g": "3.3", "carboidrato_g": "4.5", "energia_kcal": "61", "calcio_mg": "123"}),
    (11, "Gergelim, semente", "Nozes e sementes", {"proteina_g": "21.2", "lipideos_g": "50.4", "carboidrato_g": "21.6", "energia_kcal": "584", "calcio_mg": "825"}),
    (12, "Linhaça, semente", "Nozes e sementes", {"proteina_g": "14.1", "lipideos_g": "32.3", "carboidrato_g": "43.3", "energia_kcal": "495", "calcio_mg": "211"}),
    (13, "Feijão, carioca, cozido", "Leguminosas e derivados", {"proteina_g": "4.8", "lipideos_g": "0.5", "carboidrato_g": "13.6", "energia_kcal": "76", "calcio_mg": "27"}),
]
FATTY = {
    1: {"ag_18_3_n3_g": "NA", "ag_20_5_g": "NA", "ag_22_6_g": "NA", "ag_18_1t_g": "NA", "ag_18_2t_g": "Tr"},
    10: {"ag_18_3_n3_g": "0.04", "ag_20_5_g": "Tr", "ag_22_6_g": "NA", "ag_18_1t_g": "0.09", "ag_18_2t_g": "0.02"},
    12: {"ag_18_3_n3_g": "19.81", "ag_20_5_g": "NA", "ag_22_6_g": "NA", "ag_18_1t_g": "NA", "ag_18_2t_g": "NA"},
    99: {"ag_18_3_n3_g": "7", "ag_poliinsaturados_g": "70"},
}
AMINO = {6: {"aa_leucina_g": "1.8"}, 13: {"aa_leucina_g": "0.4", "aa_lisina_g": "NA"}}
