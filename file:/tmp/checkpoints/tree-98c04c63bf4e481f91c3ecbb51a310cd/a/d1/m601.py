x601