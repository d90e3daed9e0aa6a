x602