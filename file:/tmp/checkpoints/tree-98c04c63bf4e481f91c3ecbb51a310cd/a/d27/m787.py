x787