x908