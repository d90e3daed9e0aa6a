x301