x382