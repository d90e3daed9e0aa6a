x470