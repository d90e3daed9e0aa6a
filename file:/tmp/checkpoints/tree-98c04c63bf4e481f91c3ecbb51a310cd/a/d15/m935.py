x935