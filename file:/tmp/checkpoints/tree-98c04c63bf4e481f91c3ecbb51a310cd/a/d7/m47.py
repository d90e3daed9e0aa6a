x47