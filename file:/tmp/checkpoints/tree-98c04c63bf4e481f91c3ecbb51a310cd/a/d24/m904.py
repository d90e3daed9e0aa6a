x904