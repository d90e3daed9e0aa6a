x594