x773