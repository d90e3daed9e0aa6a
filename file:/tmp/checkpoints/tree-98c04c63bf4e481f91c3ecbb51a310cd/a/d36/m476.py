x476