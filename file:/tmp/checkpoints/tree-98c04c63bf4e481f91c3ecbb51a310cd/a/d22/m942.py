x942