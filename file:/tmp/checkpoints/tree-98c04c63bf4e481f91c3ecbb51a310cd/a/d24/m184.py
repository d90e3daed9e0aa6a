x184