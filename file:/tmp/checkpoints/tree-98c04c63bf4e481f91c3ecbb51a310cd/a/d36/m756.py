x756