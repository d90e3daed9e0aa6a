x875